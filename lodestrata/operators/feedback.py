"""Feedback loop and build registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def boost_weights(votes: DataFrame) -> DataFrame:
    """pos / (pos + neg + 5) * 2 - 1, and 0 for a single vote."""
    v = votes.groupBy("symbol_id").agg(F.count_if(F.col("vote") > 0).alias("pos"), F.count_if(F.col("vote") <= 0).alias("neg"))
    n = F.col("pos") + F.col("neg")
    return v.withColumn("boost", F.round(F.when(n == 1, 0.0).otherwise(F.col("pos") / (n + 5) * 2 - 1), 6))


def expansion_weights(votes: DataFrame) -> DataFrame:
    """Positive votes raise a (query, term) from 1 by 0.1 each, to 3 at most."""
    p = votes.where("vote > 0").groupBy("query_text", F.col("symbol_id").alias("term")).agg(F.count("*").alias("n"))
    return p.select("query_text", "term", F.round(F.least(1 + 0.1 * (F.col("n") - 1), F.lit(3.0)), 6).alias("weight"))


def expanded_queries(weights: DataFrame, k: int = 5) -> DataFrame:
    """A query's k terms of the largest weights above 1, joined."""
    w = Window.partitionBy("query_text").orderBy(F.desc("weight"), "term")
    best = weights.where("weight > 1").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return best.groupBy("query_text").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]), " ").alias("terms"))


def reinforcement_stats(boosts: DataFrame, weights: DataFrame) -> DataFrame:
    b = boosts.agg(F.count("*").alias("symbols"), F.count_if(F.col("boost") > 0).alias("boosted"), F.count_if(F.col("boost") < 0).alias("penalised"))
    return b.join(F.broadcast(weights.agg(F.count("*").alias("expansions"))))


#: What a text is stripped of: what \s matches, or SQL's trim (the spaces of Unicode, no tabs or line ends).
BLANKS, SPACES = " \t\n\x0b\f\r", "".join(map(chr, (0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))


def quality_gate(fb: DataFrame, blanks: str = BLANKS, null_is_empty: bool = True) -> DataFrame:
    """score 0 .. 1 from six rules, accepted above 0.5, and the reasons of a rejection.

    Without null_is_empty a null text is unknown: it earns and loses nothing and is no reason.
    """
    suggested, expected = (F.coalesce(c, F.lit("")) if null_is_empty else F.col(c) for c in ("suggestions", "expected"))
    sug, exp = (F.length(F.btrim(c, F.lit(blanks))) for c in (suggested, expected))
    rating, mentions, known = F.col("rating"), F.col("n_mentions"), F.lit(True)
    text = F.length(suggested) + F.length(expected)
    rated = rating.between(1, 5)
    rules = [
        (F.when(F.col("n_tools") > 0, 15), known, "no tools were called"),
        (F.when(mentions > 0, F.least(F.lit(20), 5 * mentions)), known, "no specific symbol or file references"),
        (F.when(sug > 30, 20).when(sug > 10, 10), sug.isNotNull(), "no actionable improvement suggestions"),
        (F.when(exp > 20, 15), exp.isNotNull(), "no expected-results description"),
        (F.when(rating.isNull(), 5).when(rated, 10 + F.when((rating <= 2) & (mentions > 0) & (F.length(suggested) > 0), 10).otherwise(0)), known, "rating out of range"),
        (F.when(text > 200, 10).when(text >= 50, 0), text.isNotNull(), "feedback too short"),
    ]
    points = sum((F.coalesce(p, F.when(of, F.lit(-5 if why == "feedback too short" else 0)), F.lit(0)) for p, of, why in rules), F.lit(0))
    reasons = F.array_join(F.array_compact(F.array(*(F.when(p.isNull() & of, F.lit(why)) for p, of, why in rules))), "; ")
    score = F.greatest(F.lit(0), F.least(F.lit(100), points))
    out = fb.withColumn("points", score).withColumn("score", F.round(F.col("points") / 100, 2)).withColumn("status", F.when(F.col("points") > 50, "accepted").otherwise("rejected"))
    return out.withColumn("reasons", F.when(F.col("points") <= 50, reasons))


def rounded(c: Column, digits: int) -> Column:
    """Rounds as SQL's engine does: the double times a power of ten, half away from zero. F.round takes the shortest decimals that
    name the double, so that 1.005, which lies below its name, becomes 1.01 and not 1.0."""
    return F.round(c * 10.0**digits) / 10.0**digits


def symbol_signals(gated: DataFrame) -> DataFrame:
    """Mean over accepted uses of (rating - 3) / 2 * score, moved by 0.3 for a helpful or unhelpful mark. A rating of 0 or null counts as 3, a score of 0 as 0.5."""
    rating = F.when(F.coalesce("rating", F.lit(0)) == 0, 3).otherwise(F.col("rating"))
    quality = F.when(F.coalesce("score", F.lit(0.0)) == 0, 0.5).otherwise(F.col("score"))
    move = F.when(F.col("helpful"), 0.3).when(~F.col("helpful"), -0.3).otherwise(0.0)
    return gated.where("status = 'accepted'").groupBy("symbol_id").agg(rounded(F.avg((rating - 3) / 2.0 * quality + move), 6).alias("signal"), F.count("*").alias("uses"))


def feedback_stats(gated: DataFrame) -> DataFrame:
    return gated.groupBy("status").agg(F.count("*").alias("n"), rounded(F.avg("score"), 4).alias("avg_score"), rounded(F.avg("rating"), 2).alias("avg_rating"))


def active_build(builds: DataFrame) -> DataFrame:
    """The latest completed build of each repository."""
    done = builds.where("status = 'completed'")
    return done.groupBy("repo").agg(F.max_by("build_id", F.struct("created_at", "build_id")).alias("build_id"))


def regressions(builds: DataFrame, least: float = 0.15) -> DataFrame:
    """Builds whose quality is below the parent's by more than `least`."""
    parent = builds.select(F.col("build_id").alias("parent_id"), F.col("quality_score").alias("parent_quality"))
    j = builds.join(parent, "parent_id")
    return j.where((F.col("parent_quality") > 0) & (F.round(F.col("quality_score") - F.col("parent_quality"), 6) < -least)).select("build_id", "parent_id", "quality_score", "parent_quality")


def rollback(builds: DataFrame, bad: DataFrame) -> DataFrame:
    """Statuses after rolling the bad builds back to their parents: (build_id, status)."""
    gone = bad.select("build_id", F.lit("rolled_back").alias("new")).distinct()
    back = bad.select(F.col("parent_id").alias("build_id"), F.lit("completed").alias("new")).distinct().join(gone, "build_id", "left_anti")
    return builds.select("build_id", "status").join(gone.unionByName(back), "build_id", "left").select("build_id", F.coalesce("new", "status").alias("status"))


def similar_query_boosts(votes: DataFrame, query: str, k: int = 5) -> DataFrame:
    """Symbols that helped with this query or one that has its first 40 characters."""
    q = query.lower()
    v = votes.where((F.col("vote") > 0) & ((F.lower("query_text") == q) | F.lower("query_text").contains(q[:40])))
    return v.groupBy("symbol_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "symbol_id").limit(k).select("symbol_id", F.round(F.least(0.1 * F.col("n"), F.lit(0.3)), 6).alias("boost"))


def nonzero_boosts(boosts: DataFrame) -> DataFrame:
    return boosts.where("boost <> 0")


def evaluate_pending(feedback: DataFrame, most: int = 50, gate: Callable[[DataFrame], DataFrame] = quality_gate) -> DataFrame:
    """All rows, the oldest `most` pending ones gated: status and score changed. Only the keys of those chosen are joined."""
    chosen = feedback.where("status = 'pending'").orderBy("created_at", "feedback_id").limit(most).select("feedback_id")
    mine = feedback.join(F.broadcast(chosen), "feedback_id", "left_semi")
    gated = gate(mine.drop("status", "score")).select("feedback_id", F.col("status").alias("new_status"), F.col("score").alias("new_score"))
    j = feedback.join(F.broadcast(gated), "feedback_id", "left")
    return j.withColumn("status", F.coalesce("new_status", "status")).withColumn("score", F.coalesce("new_score", "score")).select(*feedback.columns)


def unconsumed(feedback: DataFrame, most: int | None = None) -> DataFrame:
    """Accepted feedback that no build has consumed, the best and then the oldest first."""
    rows = feedback.where("status = 'accepted' and consumed_at is null").orderBy(F.desc("score"), "created_at", "feedback_id")
    return rows if most is None else rows.limit(most)


def consume(feedback: DataFrame, ids: DataFrame, build_id: str, at) -> DataFrame:
    """All rows; those of ids(feedback_id) are marked as consumed by the build."""
    j = feedback.join(ids.select("feedback_id", F.lit(True).alias("mine")).distinct(), "feedback_id", "left")
    mine = F.coalesce("mine", F.lit(False))
    return j.select(*(F.when(mine, F.lit(at)).otherwise(F.col(c)).alias(c) if c == "consumed_at" else F.when(mine, F.lit(build_id)).otherwise(F.col(c)).alias(c) if c == "consumed_by" else F.col(c) for c in feedback.columns))


def signal_votes(signals: DataFrame, query: str = "_ai_feedback") -> DataFrame:
    """A vote per symbol with a signal: for it if the signal is positive, else against."""
    return signals.select("symbol_id", F.lit(query).alias("query_text"), F.when(F.col("signal") > 0, 1).otherwise(-1).alias("vote"), F.lit(0.5).alias("original_score"), F.concat(F.lit("AI feedback signal (weight="), F.format_string("%.3f", "signal"), F.lit(")")).alias("reason"))


REBUILD_AT, RERANK_AT = 10, 5


def tick(feedback: DataFrame, build_id: str | None, at, most: int = 50, gate: Callable[[DataFrame], DataFrame] = quality_gate) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A round of the feedback loop: (feedback, votes to append, one row of what happened and is due).

    Pending feedback is gated; the signals of the accepted become votes; with an active build that feedback is consumed.
    due is `rebuild` from REBUILD_AT accepted and unconsumed rows before, `rerank` from RERANK_AT, else `nothing`.
    """
    gated = evaluate_pending(feedback, most, gate)
    taken = unconsumed(gated, most)
    votes = signal_votes(symbol_signals(taken))
    after = consume(gated, taken, build_id, at) if build_id is not None else gated
    n = unconsumed(gated).agg(F.count("*").alias("unconsumed"))
    due = F.when(F.col("unconsumed") >= REBUILD_AT, "rebuild").when(F.col("unconsumed") >= RERANK_AT, "rerank").otherwise("nothing")
    return after, votes, n.withColumn("due", due)


def register(builds: DataFrame, build: DataFrame) -> DataFrame:
    """builds with a new one, building, whose parent is its repository's active build."""
    active = active_build(builds).withColumnRenamed("build_id", "parent_id")
    new = build.drop("parent_id", "status").join(active, "repo", "left").withColumn("status", F.lit("building"))
    return builds.unionByName(new.select(*builds.columns))


def complete(builds: DataFrame, build_id) -> DataFrame:
    """The build is completed; the other completed ones of its repository are superseded."""
    repo = builds.where(F.col("build_id") == build_id).select("repo", F.lit(True).alias("mine"))
    j = builds.join(F.broadcast(repo), "repo", "left")
    status = F.when(F.col("build_id") == build_id, "completed").when(F.col("mine") & (F.col("status") == "completed"), "superseded").otherwise(F.col("status"))
    return j.withColumn("status", status).select(*builds.columns)


def with_quality(builds: DataFrame, build_id, score: float) -> DataFrame:
    return builds.withColumn("quality_score", F.when(F.col("build_id") == build_id, F.lit(score)).otherwise(F.col("quality_score")))


def history(builds: DataFrame, most: int = 20) -> DataFrame:
    return builds.orderBy(F.desc("created_at"), F.desc("build_id")).limit(most)
