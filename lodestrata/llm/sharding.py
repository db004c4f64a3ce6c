"""Operator 8, sharding by sampled splitters; law `bytes`: sizes near equal."""

from __future__ import annotations

import heapq
from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

#: Ranges are RANGES_PER_SHARD a shard, or more: one per ROWS_PER_RANGE rows, up to MOST_RANGES, whose plan the driver holds.
RANGES_PER_SHARD, SAMPLES_PER_RANGE = 64, 8
ROWS_PER_RANGE, MOST_RANGES = 200_000, 1 << 16


def shard(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Size: UTF-8 bytes of the text plus 8 (8 for a null text). The sort key is the 64-bit hash of the text, so that equal texts fall into one range. A
    sample of keys, weighted by size and of a bounded expected number (SAMPLES_PER_RANGE longs a range), gives the
    quantile boundaries of the ranges, whose number grows with the rows; all records are range-partitioned by them and
    the ranges measured exactly. Overfull ranges are subdivided into cells by doc_id, so no range is worked on in one
    task. Ranges go to the shards largest first, each to the emptiest shard: a shard is a set of key ranges, not one. The
    cells of a range stay together, so equal texts share a shard, unless the range alone exceeds a whole shard: its cells
    are then placed one by one, for near equal sizes. Slots count from 0 without gap in each shard, by cell and then
    (key, doc_id).

    Null and empty texts: size 8, checksum of the empty text. Texts of any length are taken whole. Repeated rows are
    kept, in neighbouring slots. Null doc_id counts as the smallest. An empty table gives no rows; further columns are
    ignored. Reruns agree.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = staged(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + F.lit(8)).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("crc"), F.xxhash64(body).alias("key"), F.xxhash64(F.lit(3), F.col(doc_id), body).alias("h")))
    total, n_rows = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if not total:
        return rows.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    ranges = max(shards * RANGES_PER_SHARD, min(MOST_RANGES, n_rows // ROWS_PER_RANGE))
    want = ranges * SAMPLES_PER_RANGE
    x = F.col("size") * F.lit(want / total)
    copies = F.floor(x + F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)))
    weighted = rows.select("key", copies.cast("long").alias("c")).where("c > 0").groupBy("key").agg(F.sum("c").alias("c"))
    sample = sorted((r.key, r.c) for r in weighted.collect())
    drawn, upto, bounds = sum(c for _, c in sample), 0, []
    for key, c in sample:
        upto += c
        while len(bounds) < ranges - 1 and upto >= (len(bounds) + 1) * drawn / ranges:
            bounds.append(key)
    bounds = sorted(set(bounds))
    # A key's range is the number of boundaries below it; a small table by the key's first 12 bits holds the few that can matter.
    first = [-(1 << 63) + (i << 52) for i in range(4097)]
    near = [(i, lo := bisect_right(bounds, first[i] - 1), bounds[lo : bisect_right(bounds, first[i + 1] - 1)]) for i in range(4096)]
    spark = docs.sparkSession
    lookup = F.broadcast(spark.createDataFrame(near, "top int, base int, bounds array<long>"))
    top = (F.shiftright("key", 52) + 2048).cast("int")
    ranged = rows.withColumn("top", top).join(lookup, "top").withColumn("range", F.col("base") + F.expr("size(filter(bounds, b -> b < key))")).drop("top", "base", "bounds")
    even = F.lit(2.0 * total / ranges)
    sizes = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    cells_of = F.greatest(F.ceil(F.col("bytes") / even), F.ceil(F.col("n") / F.lit(max(1.0, 2.0 * n_rows / ranges)))).cast("long")
    split = spark.createDataFrame([tuple(r) for r in sizes.select("range", cells_of.alias("cells")).where("cells > 1").collect()], "range int, cells long")
    celled = staged(ranged.join(F.broadcast(split), "range", "left").withColumn("cell", F.pmod(F.col("h"), F.coalesce("cells", F.lit(1))).cast("int")).drop("cells", "h"))
    found = celled.groupBy("range", "cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()  # at most two cells a range on average
    plan = _place([tuple(r) for r in found], shards, total)
    plan = F.broadcast(spark.createDataFrame(plan, "range int, cell int, shard int, before long"))
    slot = F.row_number().over(Window.partitionBy("range", "cell").orderBy("key", "doc_id", "size")) - 1
    out = celled.withColumn("at", slot).join(plan, ["range", "cell"])
    return out.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("at") + F.col("before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _place(cells: list[tuple[int, int, int, int]], shards: int, total: int) -> list[tuple[int, int, int, int]]:
    """(range, cell, bytes, n) -> (range, cell, shard, slots before it): largest first to the emptiest shard."""
    by_range: dict[int, list[tuple[int, int, int, int]]] = {}
    for c in sorted(cells):
        by_range.setdefault(c[0], []).append(c)
    units = []
    for own in by_range.values():
        units += [[c] for c in own] if sum(c[2] for c in own) > total / shards else [own]
    units.sort(key=lambda u: (-sum(c[2] for c in u), u[0][:2]))
    heap, placed = [(0, s) for s in range(shards)], []
    for u in units:
        used, s = heapq.heappop(heap)
        placed += [(s, c) for c in u]
        heapq.heappush(heap, (used + sum(c[2] for c in u), s))
    out, before = [], [0] * shards
    for s, (r, cell, _, n) in sorted(placed):
        out.append((r, cell, s, before[s]))
        before[s] += n
    return out


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
