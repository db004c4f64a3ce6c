"""Text and vector retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import stage

K1, B = 1.2, 0.75


def hash_embedding(text: Column, dims: int = 16) -> Column:
    """The bytes of the text's SHA-256, scaled to -1 .. 1."""
    h = F.sha2(text, 256)
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.conv(F.substring(h, (2 * (i % 32) + 1).cast("int"), F.lit(2)), 16, 10).cast("int") / 255.0 * 2 - 1)


def cosine(a: Column, b: Column) -> Column:
    """0 if either norm is 0; the longer vector is cut to the shorter."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, z: s + z)
    dot, na, nb = total(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))), total(F.transform(x, lambda p: p.cast("double") * p.cast("double"))), total(F.transform(y, lambda p: p.cast("double") * p.cast("double")))
    return F.when((na == 0) | (nb == 0), 0.0).otherwise(dot / (F.sqrt(na) * F.sqrt(nb)))


def top_k(vectors: DataFrame, query: list[float], k: int, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k most similar rows; the query is a constant of the plan, and each task keeps k rows."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(key, F.round(cosine(F.col(vec), q), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))


def postings(chunks: DataFrame, key: str = "doc_id", text: str = "content") -> DataFrame:
    """(term, key, tf, len) of every chunk, to be written once and read by term."""
    t = chunks.select(key, tokens(F.col(text)).alias("t")).select(key, F.size("t").alias("len"), F.explode("t").alias("term"))
    return t.groupBy("term", key, "len").agg(F.count("*").alias("tf"))


def bm25(chunks: DataFrame, terms: list[str], key: str = "doc_id", text: str = "content") -> DataFrame:
    """(key, score) of every chunk with one of the terms. Texts are cut once: their lengths and the terms' counts are staged,
    and both the corpus statistics, one row, and the scores come from there."""
    tf = lambda w: F.size(F.filter("t", lambda x: x == w))
    t = chunks.select(key, tokens(F.col(text)).alias("t"))
    lens = stage(t.select(key, F.size("t").alias("len"), *(tf(w).alias(f"tf_{i}") for i, w in enumerate(terms))))
    stats = lens.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *(F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(terms))))
    idf = lambda i: F.log(1 + (F.col("n") - F.col(f"df_{i}") + 0.5) / (F.col(f"df_{i}") + 0.5))
    part = lambda i: idf(i) * F.col(f"tf_{i}") * (K1 + 1) / (F.col(f"tf_{i}") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    score = sum((part(i) for i in range(1, len(terms))), part(0))
    hit = sum((F.col(f"tf_{i}") for i in range(1, len(terms))), F.col("tf_0"))
    return lens.where(hit > 0).join(F.broadcast(stats)).select(key, score.alias("score"))


def min_max(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns scaled to 0 .. 1 over all rows, 0 if all are equal; the extremes are one row, which is broadcast."""
    ends = rows.agg(*(f(c).alias(f"{c}_{f.__name__}_") for c in columns for f in (F.min, F.max)))
    low, high = (lambda c: F.col(f"{c}_min_")), (lambda c: F.col(f"{c}_max_"))
    scaled = {c: F.when(high(c) > low(c), (F.col(c) - low(c)) / (high(c) - low(c))).otherwise(0.0) for c in columns}
    return rows.join(F.broadcast(ends)).select(*(scaled[c].alias(c) if c in scaled else F.col(c) for c in rows.columns))


#: Queries that one pass over the vectors answers: a block is collected and broadcast.
QUERY_BLOCK = 4096


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 1, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(query, match, score): the k most similar other rows of each row of queries(key, vec), ties to the smaller key.

    Queries go in blocks of a fixed size; each task keeps k rows a query, and the best of all tasks are taken.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    asked = stage(queries.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v")))
    blocks, parts = -(-asked.count() // QUERY_BLOCK), []

    def search(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = block.value
            best_score, best_id = np.full((len(ids), 0), 0.0), np.full((len(ids), 0), 0)
            for batch in batches:
                own = batch.column(0).to_numpy()
                v = np.array(batch.column(1).to_pylist(), float).reshape(len(own), -1)
                norm = np.linalg.norm(v, axis=1)
                for at in range(0, len(own), 4096):
                    part, some = v[at : at + 4096], own[at : at + 4096]
                    score = np.where(norm[at : at + 4096] > 0, q @ part.T / np.where(norm[at : at + 4096] > 0, norm[at : at + 4096], 1), 0.0)
                    score[ids[:, None] == some[None, :]] = -np.inf
                    all_score, all_id = np.hstack([best_score, score]), np.hstack([best_id, np.broadcast_to(some, score.shape)])
                    order = np.lexsort((all_id, -all_score), axis=1)[:, :k]
                    best_score, best_id = np.take_along_axis(all_score, order, 1), np.take_along_axis(all_id, order, 1)
            known = np.isfinite(best_score)
            yield pa.record_batch([pa.array(np.repeat(ids, known.sum(axis=1))), pa.array(best_id[known]), pa.array(best_score[known])], ["query", "match", "score"])

        return run

    for i in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).collect()
        q = np.array([r.v for r in own], float).reshape(len(own), -1)
        norm = np.linalg.norm(q, axis=1, keepdims=True) if q.size else q
        block = spark.sparkContext.broadcast((np.array([r.id for r in own], np.int64), q / np.where(norm > 0, norm, 1) if q.size else q))
        parts.append(rows.mapInArrow(search(block), "query long, match long, score double"))
    if not parts:
        return spark.createDataFrame([], "query long, match long, score double")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    if k == 1:
        best = every.groupBy("query").agg(F.max_by(F.struct("match", "score"), F.struct("score", (-F.col("match")).alias("m"))).alias("x"))
        return best.select("query", "x.match", "x.score")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "match")
    return every.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def merged(results: list[DataFrame], k: int) -> DataFrame:
    """The k best rows(symbol_id, score) of several collections; a symbol in two of them counts twice."""
    every = results[0]
    for r in results[1:]:
        every = every.unionByName(r)
    return every.orderBy(F.desc("score"), "symbol_id").limit(k)


def search_symbols(symbols: DataFrame, query: str, limit: int = 20) -> DataFrame:
    return symbols.where(F.lower("symbol_id").contains(query.lower())).orderBy("symbol_id").limit(limit)


def search_enhanced(symbols: DataFrame, query: str, limit: int = 20, kinds: list[str] | None = None) -> DataFrame:
    """(symbol_id, match_type): ids, else mutual substrings of short names, then file paths, to the limit; of kinds, if given."""
    q = query.lower()
    name, on = F.lower("short_name"), lambda kind: F.lit(kinds is None or kind in kinds)
    found = symbols.select("symbol_id", F.lower("symbol_id").contains(q).alias("id"), (on("fuzzy_name") & (name.contains(q) | F.lit(q).contains(name))).alias("name"), (on("file_path") & F.lower("file_path").contains(q.replace(".rs", ""))).alias("file")).where("id or name or file")
    any_id = F.broadcast(found.agg(F.count_if("id").alias("ids")))
    rank = F.when(F.col("id"), 0).when(F.col("name") & (F.col("ids") == 0), 1).when(F.col("file"), 2)
    rows = found.join(any_id).select("symbol_id", rank.alias("rank")).where("rank is not null").orderBy("rank", "symbol_id").limit(limit)
    return rows.select("symbol_id", F.element_at(F.array(*map(F.lit, ("symbol", "fuzzy_name", "file_path"))), F.col("rank") + 1).alias("match_type"))


def path_matches(symbols: DataFrame, path: str) -> DataFrame:
    p = F.col("file_path")
    return symbols.where((p == path) | p.endswith(path) | F.endswith(F.lit(path), p))


def preview(chunks: DataFrame, key: str = "symbol_id", text: str = "content", most: int = 8000) -> DataFrame:
    return chunks.select(key, F.length(F.substring(text, 1, most)).alias("shown"), (F.length(text) > most).alias("truncated"), F.substring(text, 1, 300).alias("preview"))


def reranked(scores: DataFrame, boosts: DataFrame, on: str, k: int, alpha: float = 0.15) -> DataFrame:
    """score + alpha * boost (0 where there is none), sorted, cut to k."""
    s = scores.join(boosts, on, "left").withColumn("final", F.round(F.col("score") + alpha * F.coalesce("boost", F.lit(0.0)), 4))
    return s.orderBy(F.desc("final"), on).limit(k).select(on, "final")


def kind_factor(rows: DataFrame) -> DataFrame:
    """score: of file summaries raised to 1.6 times, 1 at most, of module exports cut to a fifth."""
    return rows.withColumn("score", F.when(F.col("kind") == "file_summary", F.least(F.col("score") * 1.6, F.lit(1.0))).when(F.col("kind") == "module_exports", F.col("score") * 0.2).otherwise(F.col("score")))


def path_boost(rows: DataFrame, query: str) -> DataFrame:
    """score raised by 25 % a shared path token and 20 % a shared stem token, each capped at 1."""
    q = F.array_distinct(tokens(F.lit(query)))
    shared = F.size(F.array_intersect(q, tokens(F.col("file_path"))))
    stem = F.size(F.array_intersect(q, tokens(F.regexp_replace(F.regexp_extract("file_path", "([^/]*)$", 1), r"\.[^.]*$", ""))))
    s = F.when(shared > 0, F.least(F.col("score") * (1 + 0.25 * shared), F.lit(1.0))).otherwise(F.col("score"))
    return rows.withColumn("s", s).withColumn("boosted", F.round(F.when(stem > 0, F.least(F.col("s") * (1 + 0.2 * stem), F.lit(1.0))).otherwise(F.col("s")), 6)).drop("s")


def top_per(rows: DataFrame, by: str, score: str, key: str, k: int = 1) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(score), key)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def directory_quota(rows: DataFrame, most_files: int = 8) -> DataFrame:
    """Greedy choice by score with a quota for each directory that depends on the score's tier: (symbol_id, dir, score, place).

    Within a directory scores fall, so quotas do too and the first row refused ends its directory: a row is chosen exactly if
    its rank in the directory is within its quota. A window thereby replaces the loop.
    """
    s = F.col("score")
    quota = F.when(s >= 0.75, 99).when(s >= 0.55, 4).when(s >= 0.45, 2).otherwise(1)
    rank = F.row_number().over(Window.partitionBy("dir").orderBy(F.desc("score"), "symbol_id"))
    kept = rows.where(s >= 0.4).withColumn("rank", rank).where(F.col("rank") <= quota).orderBy(F.desc("score"), "symbol_id").limit(most_files)
    return kept.select("symbol_id", "dir", "score", F.row_number().over(Window.orderBy(F.desc("score"), "symbol_id")).alias("place"))


def within_budget(rows: DataFrame, budget: int, most: int = 25, whole: float = 0.6) -> DataFrame:
    """The best `most` rows in order of score until their lengths reach the budget: adds used_before and shown, the length
    taken; a row of a score under `whole` is cut to what is left. The window holds `most` rows."""
    best = rows.orderBy(F.desc("score"), "symbol_id").limit(most)
    before = F.coalesce(F.sum("len").over(Window.orderBy(F.desc("score"), "symbol_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = best.withColumn("used_before", before).where(F.col("used_before") < budget)
    return out.withColumn("shown", F.when(F.col("score") >= whole, F.col("len")).otherwise(F.least(F.col("len"), F.lit(budget) - F.col("used_before"))))


def with_company(chosen: DataFrame, files: DataFrame, edges: DataFrame, symbols: DataFrame, budget: int, siblings: int = 6) -> DataFrame:
    """(file_path, why): the files of chosen(file_path, symbol_id, shown), while under 70 % of the budget is used up to six
    other files of their folders, and while under 90 % is used files with neighbours of the chosen symbols, most first."""
    used = F.broadcast(chosen.agg(F.coalesce(F.sum("shown"), F.lit(0)).alias("used")))
    folder = F.regexp_extract("file_path", "^(.*)/", 1)
    own = chosen.select("file_path").distinct()
    near = files.select("file_path").distinct().withColumn("dir", folder).join(own.select(folder.alias("dir")).distinct(), "dir", "left_semi").join(own, "file_path", "left_anti")
    near = near.select("file_path").orderBy("file_path").limit(siblings).join(used).where(F.col("used") < 0.7 * budget).select("file_path", F.lit("sibling").alias("why"))
    ids = chosen.select("symbol_id").distinct()
    ends = edges.join(F.broadcast(ids), edges.src == ids.symbol_id, "left_semi").select(F.col("dst").alias("symbol_id")).unionByName(edges.join(F.broadcast(ids), edges.dst == ids.symbol_id, "left_semi").select(F.col("src").alias("symbol_id"))).distinct()
    linked = symbols.join(ends, "symbol_id", "left_semi").groupBy("file_path").agg(F.countDistinct("symbol_id").alias("n")).join(own, "file_path", "left_anti").orderBy(F.desc("n"), "file_path").limit(siblings)
    linked = linked.join(near.select("file_path"), "file_path", "left_anti").join(used).where(F.col("used") < 0.9 * budget).select("file_path", F.lit("linked").alias("why"))
    return own.select("file_path", F.lit("chosen").alias("why")).unionByName(near).unionByName(linked)
