"""Operator 4, mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, dropped, join_groups, staged, table, unit

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Offsets that a source tries.
OFFSETS = 32


def plan_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources(nosrc, source, source_size, n): adds target, the water level over capped weights.

    Sources are numbered in order by range partitions and the counts of the partitions before, so that no task holds them
    all. The level starts as if no source were capped; those whose cap it reaches are capped and the rest share what is
    left, until no more are. Only sums reach the driver.
    """
    part, line = F.spark_partition_id(), F.monotonically_increasing_id()
    ordered = staged(sources.repartitionByRange("nosrc", "source").sortWithinPartitions("nosrc", "source").withColumn("part", part).withColumn("line", F.shiftright(F.shiftleft(line, 31), 31)))
    before, starts = 0, []
    for r in ordered.groupBy("part").count().orderBy("part").collect():  # a row per partition
        starts.append((r.part, before))
        before += r["count"]
    spark = sources.sparkSession
    rank = F.col("start") + F.col("line")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    s = ordered.join(F.broadcast(spark.createDataFrame(starts, "part int, start long")), "part").withColumn("w", w).drop("part", "line", "start")
    s = staged(s.withColumn("cap", F.col("source_size") * F.lit(most)))
    dropped(ordered)
    budget, w_all = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)) * share, F.coalesce(F.sum("w"), F.lit(0.0))).first()
    level, capped = (budget / w_all if w_all else 0.0), -1
    while True:
        reached = F.col("cap") <= F.lit(level) * F.col("w")
        n, cap, w_capped = s.where(reached).agg(F.count("*"), F.coalesce(F.sum("cap"), F.lit(0.0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
        if n == capped or w_capped >= w_all:
            break
        capped, level = n, (budget - cap) / (w_all - w_capped)
    return s.withColumn("target", F.when(reached, F.col("cap")).otherwise(F.col("w") * F.lit(level))).select("nosrc", "source", "source_size", "n", "target")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 7) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, copies, taken.

    A document of a source is expected target / source_size times. The documents of a source stand in the order
    (bin, size, doc_id), bins being random by doc_id; the prefix sum of expected copies is the rank times that rate.
    One offset in [0, 1) for each source is added and a copy is emitted for each integer crossed, so copies are the
    rate rounded down or up. The offset is random, up to a rotation: of OFFSETS equal rotations the one whose words come nearest the target is taken,
    since a source of few documents may else miss it by the size of its largest ones. Bins (some 65,536 in all, of 256 rows at least) are ranked separately and moved by the
    counts of the bins before, so a hot source is never sorted in one task. What belongs to a source is
    joined by broadcast for the under HOT_SHARE sources that are large, and by a shuffle for the small ones.

    Null text: size 0. Null source: a source of its own, last in order. Sources with no words have target 0 and no copies.
    Repeated rows and ties stand beside each other in the order and are sampled as separate rows. Reruns agree. Further
    columns are ignored; an empty table gives no rows.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    rows = staged(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.isnull(source).cast("int").alias("nosrc"), size.alias("size"), unit(F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).alias("u")))
    stats = rows.groupBy("nosrc", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    keys, total = ["nosrc", "source"], rows.count()
    per_bin = max(256, -(-total // 65536))
    plan = staged(plan_targets(stats, weights, share, most).withColumn("bins", F.ceil(F.col("n") / per_bin).cast("long")))
    sized, rows = rows, staged(join_groups(rows, plan, keys, "n", total).withColumn("bin", F.floor(F.col("u") * F.col("bins")).cast("long")))
    dropped(sized, plan)
    binned = rows
    in_source = Window.partitionBy("nosrc", "source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = rows.groupBy("nosrc", "source", "bin").agg(F.count("*").alias("n_bin")).withColumn("before", F.coalesce(F.sum("n_bin").over(in_source), F.lit(0))).drop("n_bin")
    rank = F.row_number().over(Window.partitionBy("nosrc", "source", "bin").orderBy("size", "doc_id"))
    rows = rows.withColumn("rank", rank).join(bins, ["nosrc", "source", "bin"]).withColumn("rank", F.col("rank") + F.col("before"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = unit(F.lit(str(seed)), F.lit("offset"), F.col("nosrc").cast("string"), F.col("source"))
    copies = lambda o: (F.floor(F.col("rank") * F.col("rate") + o) - F.floor((F.col("rank") - 1) * F.col("rate") + o)).cast("long")
    rows = staged(rows.withColumn("rate", rate).withColumn("start", start).select("nosrc", "source", "doc_id", "size", "source_size", "target", "rate", "start", "rank"))
    dropped(binned)
    rotated = [F.col("start") + F.lit(k / OFFSETS) for k in range(OFFSETS)]
    misses = [F.struct(F.abs(F.sum(F.col("size") * copies(o)) - F.first("target")).alias("miss"), F.lit(k / OFFSETS).alias("turn")) for k, o in enumerate(rotated)]
    best = staged(rows.groupBy("nosrc", "source").agg(F.array_min(F.array(*misses))["turn"].alias("turn"), F.count("*").alias("n")))
    rows = join_groups(rows, best, keys, "n", total).withColumn("copies", copies(F.col("start") + F.col("turn")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("copies")


def mixing_sql(docs: str = "documents", seed: int = 7) -> str:
    """The copies of mix() in DuckDB SQL, over the table or subquery docs."""
    unit_of = lambda s: f"(('0x' || substr(md5({s}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
    return f"""
WITH r AS (SELECT doc_id, coalesce(source, '') AS source, (source IS NULL)::INT AS nosrc,
    CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size,
    {unit_of(f"'{seed}:' || coalesce(doc_id::VARCHAR, '')")} AS u FROM {docs}),
s AS (SELECT nosrc, source, sum(size)::BIGINT AS source_size, count(*) AS n FROM r GROUP BY ALL),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY nosrc, source) - 1) % 3 + 1)::INT]::DOUBLE AS w,
    source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS budget,
    ceil(n / greatest(256, ceil(sum(n) OVER () / 65536.0)))::BIGINT AS bins FROM s),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) >= cap / w AS capped
    FROM w WINDOW b AS (ORDER BY cap / w, nosrc, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, CASE WHEN capped THEN cap ELSE w * ((budget - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())
    / sum(CASE WHEN capped THEN 0 ELSE w END) OVER ()) END AS target FROM l),
k AS (SELECT r.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    {unit_of(f"'{seed}:offset:' || nosrc || ':' || source")} AS o,
    row_number() OVER (PARTITION BY nosrc, source ORDER BY floor(u * t.bins), size, doc_id) AS rk FROM r JOIN t USING (nosrc, source)),
m AS (SELECT nosrc, source, any_value(target) AS target, i / 32.0::DOUBLE AS turn,
    sum(size * (floor(rk * rate + (o + i / 32.0::DOUBLE)) - floor((rk - 1) * rate + (o + i / 32.0::DOUBLE)))) AS got
    FROM k, range(32) t(i) GROUP BY nosrc, source, i),
b AS (SELECT nosrc, source, arg_min(turn, (abs(got - target), turn)) AS turn FROM m GROUP BY ALL),
c AS (SELECT doc_id, size, source_size, target, (floor(rk * rate + (o + turn)) - floor((rk - 1) * rate + (o + turn)))::BIGINT AS copies
    FROM k JOIN b USING (nosrc, source))
"""


OP4_SQL = mixing_sql() + "SELECT doc_id, size, source_size, target, copies * size AS taken FROM c"
