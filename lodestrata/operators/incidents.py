"""Incident sessions, evaluation, metrics, chat."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import stage

CHAIN = ("CREATED", "INGESTING", "RETRIEVING", "GRAPH_EXPANDING", "GENERATING_PATCH", "VALIDATING", "RESOLVED")
FINAL = ("RESOLVED", "FAILED")


def allowed(state: str | None, new: str) -> bool:
    """A session starts at CREATED, moves one step along the chain, or fails unless it has ended."""
    if state is None:
        return new == "CREATED"
    return state not in FINAL and (new == "FAILED" or CHAIN.index(new) == CHAIN.index(state) + 1 if new in CHAIN or new == "FAILED" else False)


def latest_state(events: DataFrame) -> DataFrame:
    return events.groupBy("session_id").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("events"))


def transition_validity(events: DataFrame) -> DataFrame:
    """Each event against the one before it."""
    w = Window.partitionBy("session_id").orderBy("ts", "event_id")
    prev = F.lag("state").over(w)
    order = F.create_map(*(F.lit(x) for i, s in enumerate(CHAIN) for x in (s, i)))
    ok = F.when(F.col("prev").isNull(), F.col("state") == "CREATED").when(F.col("prev").isin(*FINAL), False).when(F.col("state") == "FAILED", True).otherwise(F.coalesce(order[F.col("state")] == order[F.col("prev")] + 1, F.lit(False)))
    return events.withColumn("prev", prev).select("session_id", "event_id", "state", "prev", ok.alias("valid"))


def hydrate(events: DataFrame) -> DataFrame:
    """A session's timeline in one row."""
    line = F.array_sort(F.collect_list(F.struct("ts", "event_id", "state")))
    return events.groupBy("session_id").agg(F.array_join(F.transform(line, lambda x: F.concat(x["event_id"].cast("string"), F.lit(":"), x["state"])), ",").alias("timeline"))


def last_with(events: DataFrame, state: str) -> DataFrame:
    """A session's last event of the state."""
    return events.where(F.col("state") == state).groupBy("session_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def latency(events: DataFrame, by: str, value: str) -> DataFrame:
    """Mean and nearest-rank percentiles: the element floor(n * p), from 0, of the sorted values.

    Rows are range-partitioned by key and value, so that a key of most rows is sorted by many tasks; the counts of a key
    in the partitions before tell which partition and line hold the wanted elements.
    """
    rows = events.where(F.col(value).isNotNull()).select(by, value).repartitionByRange(by, value).sortWithinPartitions(by, value)
    rows = stage(rows.withColumn("part", F.spark_partition_id()).withColumn("line", F.monotonically_increasing_id()))
    w = Window.partitionBy(by)
    per = rows.groupBy(by, "part").agg(F.count("*").alias("own"), F.min("line").alias("first"), F.sum(value).alias("sum"))
    per = per.withColumn("before", F.coalesce(F.sum("own").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("own").over(w)).withColumn("mean", F.round(F.sum("sum").over(w) / F.col("n"), 6))
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.floor(F.col("n") * p).alias("i")) for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))))
    at = per.select(by, "part", "n", "mean", "before", "own", "first", wanted.alias("x")).where("x.i >= before and x.i < before + own").select(by, "n", "mean", "part", (F.col("first") + F.col("x.i") - F.col("before")).alias("line"), "x.name")
    found = rows.select("part", "line", F.col(value).alias("found")).join(at, ["part", "line"])
    return found.groupBy(by, "n", "mean").agg(*(F.max(F.when(F.col("name") == p, F.col("found"))).alias(p) for p in ("p50", "p95", "p99")))


def throughput(events: DataFrame) -> DataFrame:
    return events.groupBy(F.date_trunc("minute", "ts").alias("minute")).agg(F.count("*").alias("n"))


def window_counts(events: DataFrame, seconds: int, key: str = "session_id") -> DataFrame:
    """Events of the key in the seconds before each, both edges included."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.select("event_id", F.count("*").over(w).alias("n"))


def eval_suite(expected: DataFrame, actual: DataFrame, on: str) -> DataFrame:
    j = expected.join(actual, on, "left")
    return j.agg(F.count("*").alias("total"), F.count_if(F.col("expected") == F.col("actual")).alias("passed"), F.count_if(F.col("expected") != F.col("actual")).alias("failed"), F.count_if(F.col("actual").isNull()).alias("errors"))


def history_tail(messages: DataFrame, k: int = 20) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("back", F.row_number().over(w)).where(F.col("back") <= k)


#: Fixed list of words that a title leaves out.
FILLER = """a an the is are was were be been being have has had do does did will would could should may might can shall to of in for
on with at by from as into about like through after over between out against during without before under around among and but or
nor not so yet both either neither each every all any few more most other some such no only own same than too very
just because if when where how what which who whom this that these those i me my we our you your he him his she her
it its they them their please tell know give show explain help want need get let also whatever whatevre etc well basically
actually really much many thing things bout abt pls thx tho kinda""".split()


def titles(messages: DataFrame, text: str = "text") -> DataFrame:
    """Up to eight words that say something, else the first six; over 60 characters cut to 57 and an ellipsis."""
    words = F.filter(F.split(F.translate(F.col(text), "?!.,;:\n\t\r", "         "), " +"), lambda w: w != "")
    key = F.filter("words", lambda w: ~F.lower(w).isin(FILLER))
    title = F.array_join(F.when(F.size("key") > 0, F.slice("key", 1, 8)).otherwise(F.slice("words", 1, 6)), " ")
    return messages.withColumn("words", words).withColumn("key", key).withColumn("t", title).withColumn("title", F.when(F.length("t") > 60, F.concat(F.substring("t", 1, 57), F.lit("..."))).otherwise(F.col("t"))).drop("words", "key", "t")
