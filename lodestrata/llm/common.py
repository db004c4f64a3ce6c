"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space and \t..\r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Whether Spark deletes the shuffle files of a query once it has run.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary folder if driver and
    executors are one process, as in tests; an error on a cluster, whose machines wouldn't see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lodestrata-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def setting(spark: SparkSession, key: str, value: object) -> Iterator[None]:
    """A setting of the session within a block; afterwards it is as before."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def staged(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """Writes df to the shared folder and rereads it: lineage ends here and a lost executor costs no recomputation.

    The folder stays until dropped(); what a returned plan still reads is left to the owner of the shared folder. The
    write's shuffle files, which nothing else reads, go at its end, not when the driver happens to collect its garbage.
    batch_rows: rows of an Arrow batch in this write, if not as many as the session has.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    with setting(spark, SHUFFLE_CLEANUP, "true"), setting(spark, rows, batch_rows or spark.conf.get(rows)):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the folders of staged tables whose successors are written: no plan that is still to run may read them."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows and bytes of an Arrow batch at most, where whole texts or their sets go to the workers.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df; lowers the session's Arrow batches to BATCH_ROWS and BATCH_BYTES, unless they are smaller: by default 10,000 rows meet
    in one, which of long texts are hundreds of MB in the executor and its workers, twice while a vector grows. The setting
    stays, since plans run after the operator has returned."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(re.match(r"-?\d+", df.sparkSession.conf.get(key))[0])
        if not 0 < now <= most:
            df.sparkSession.conf.set(key, most)
    return df


def free_name(name: str, taken: list[str]) -> str:
    """name, with underscores until no column is called so (case aside)."""
    while name.lower() in {x.lower() for x in taken}:
        name += "_"
    return name


def unit(*cols: Column | str) -> Column:
    """A repeatable number in [0, 1) from the columns, the same in any SQL engine with md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


#: A group counts as hot beyond 1/HOT_SHARE of all rows, so that there are under HOT_SHARE hot groups.
HOT_SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """rows LEFT JOIN groups ON keys, where groups has one row per key with its number of rows in `size`.

    The groups with over total / HOT_SHARE rows number under HOT_SHARE, so they are broadcast and their rows don't
    shuffle; all other keys are small and take part in an ordinary join.
    """
    hot = F.col(size) > max(1, total // HOT_SHARE)
    extra = [c for c in groups.columns if c not in keys]
    first = rows.join(F.broadcast(groups.where(hot)), keys, "left")
    found = first.where(F.col(size).isNotNull())
    rest = first.where(F.col(size).isNull()).drop(*extra)
    return found.select(*rows.columns, *extra).unionByName(rest.join(groups.where(~hot), keys, "left").select(*rows.columns, *extra))


#: Bits of one bitmap, as bitmap_construct_agg fixes it, and the most bitmaps of 4 KB that a filter broadcasts: 32 MB.
BITMAP, MAX_BITMAPS = 32768, 8192


def slots_for(keys: int, bits_a_key: int = 16) -> int:
    """Bits of a filter for so many keys, a power of two within the bound."""
    return BITMAP * min(MAX_BITMAPS, 1 << max(0, math.ceil(math.log2(max(1, keys * bits_a_key / BITMAP)))))


def slot_of(h: Column, slots: int) -> Column:
    return F.pmod(h, F.lit(slots))


def has_bit(bits: str, at: str) -> Column:
    """Whether the bitmap in column bits has the bit whose number is in column at; false for a null bitmap."""
    return F.coalesce(F.expr(f"(conv(hex(substring({bits}, {at} div 8 + 1, 1)), 16, 10) >> ({at} % 8)) & 1 = 1"), F.lit(False))


def only_marked(rows: DataFrame, marked: DataFrame, slot: str = "slot") -> DataFrame:
    """rows with a boolean column maybe: whether `marked` has the row's slot. The filter is broadcast as bitmaps."""
    bits = marked.groupBy(F.expr(f"{slot} div {BITMAP}").alias("bucket")).agg(F.expr(f"bitmap_construct_agg({slot} % {BITMAP})").alias("bits"))
    bit = F.expr(f"(conv(hex(substring(bits, cast(({slot} % {BITMAP}) div 8 as int) + 1, 1)), 16, 10) >> cast({slot} % 8 as int)) & 1 = 1")
    joined = rows.withColumn("bucket", F.expr(f"{slot} div {BITMAP}")).join(F.broadcast(bits), "bucket", "left")
    return joined.withColumn("maybe", F.coalesce(bit, F.lit(False))).drop("bucket", "bits")


def with_decision(docs: DataFrame, decided: DataFrame, total: int, key: str = "doc_id", name: str = "decided") -> DataFrame:
    """docs with a column `name`: the number 0, 1 or 2 that decided(key, value) has for the key (one row per key, nulls too).

    Where all keys of a filter slot have one value, the row takes it in place: the filter is broadcast as bitmaps of a
    bounded size. Only rows in slots of several values shuffle, to be joined by key; a filter that is too small for its
    input sends more rows there and decides none wrongly. Keys that `decided` lacks have null or any value.
    """
    slots = slots_for(total, 8)
    slot, bucket, at, bits = (free_name(x, docs.columns) for x in ("slot", "bucket", "at", "bits"))
    hashed = lambda c: slot_of(F.xxhash64(c), slots)
    one = decided.select(hashed(F.col(key)).alias("s"), F.col("value").cast("int").alias("value")).groupBy("s").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    construct = lambda cond: F.expr(f"bitmap_construct_agg(s % {BITMAP}) filter (where {cond})")
    maps = one.groupBy(F.expr(f"s div {BITMAP}").alias(bucket)).agg(F.struct(construct("low <> high").alias("mixed"), construct("low = high and low = 1").alias("one"), construct("low = high and low = 2").alias("two")).alias(bits))
    rows = docs.withColumn(slot, hashed(docs[key])).withColumn(bucket, F.expr(f"{slot} div {BITMAP}")).withColumn(at, F.expr(f"cast({slot} % {BITMAP} as int)"))
    rows = rows.join(F.broadcast(maps), bucket, "left")
    bit = lambda m: has_bit(f"{bits}.{m}", at)
    mixed = free_name("mixed", docs.columns)
    rows = rows.select(*(F.col(c) for c in docs.columns), bit("mixed").alias(mixed), F.when(bit("one"), 1).when(bit("two"), 2).otherwise(0).alias(name))
    sure = rows.where(~F.col(mixed)).select(*docs.columns, name)
    other = decided.select(F.col(key).alias(slot), F.col("value").cast("int").alias(bits))
    rest = rows.where(F.col(mixed)).drop(name)
    rest = rest.join(other, F.col(key).eqNullSafe(F.col(slot)), "left").select(*(F.col(c) for c in docs.columns), F.col(bits).alias(name))
    return sure.unionByName(rest)


def connected(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 128) -> DataFrame:
    """(node, label): label is the smallest node reachable over the edges; nodes without an edge are absent.

    Each round hooks every node to its smallest neighbour if that is smaller, jumps pointers to the roots and contracts
    the edges to edges between roots, until none is left. A root that no other hooked to has a smaller neighbour in the
    next round, so two rounds halve the roots that have edges, at least, and the rounds grow with the logarithm of
    the nodes. Every round is written to the shared folder; only whether rows are left reaches the driver. More rounds
    than the bound raise an error.
    """
    left = staged(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    labels = None
    for _ in range(rounds):
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = staged(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low")).select("node", F.least("node", "low").alias("label")))
        while True:
            jump = up.select(F.col("node").alias("label"), F.col("label").alias("next"))
            new = staged(up.join(jump, "label").select("node", F.col("label").alias("old"), F.col("next").alias("label")))
            dropped(up)
            up = new
            if new.where("old <> label").isEmpty():
                break
        tops = up.select("node", "label")
        if labels is None:
            labels = staged(tops)
        else:
            old, labels = labels, staged(labels.join(tops.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("label")))
            dropped(old)
        ends = (tops.select(F.col("node").alias(x), F.col("label").alias(f"{x}_top")) for x in "uv")
        old, left = left, left.join(next(ends), "u").join(next(ends), "v").select(F.greatest("u_top", "v_top").alias("u"), F.least("u_top", "v_top").alias("v"))
        left = staged(left.where("u <> v").distinct())
        dropped(old, up)
        if left.isEmpty():
            dropped(left)
            return labels
    raise RuntimeError(f"components are not complete after {rounds} rounds")
