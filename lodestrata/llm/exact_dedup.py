"""Operator 3, exact dedup: two-pass Bloom filtering; only rows with a possibly repeated hash shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups, only_marked, slot_of, slots_for, staged, table


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text counts as empty. Of equal texts the row with the largest doc_id stays.
    First pass: every text's hash sets a slot of a filter. Tasks count their slots before they shuffle, 12 bytes for each
    that a task has set, and those set at least twice become bitmaps of a bounded size. Second pass: rows whose slot is
    not marked are certainly unique and pass straight through; only marked digests (never texts) shuffle. A filter too
    small for its input marks more rows and is still right.

    Empty texts and texts of any length are like others. Null doc_id: the row belongs to its group, never becomes keep_id unless all ids of the group are null (keep_id is
    then null, kept false). Repeated rows (same doc_id and text) share their values of kept. An empty table gives no
    rows. Further columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    digests = staged(docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(body, 256)).alias("sha"), F.xxhash64(body).alias("h")))
    total = digests.count()
    rows = digests.select("doc_id", "sha", slot_of(F.col("h"), slots_for(total)).alias("slot"))
    marked = rows.groupBy("slot").count().where("count > 1")
    seen = only_marked(rows, marked).select("doc_id", "sha", "maybe")
    seen = staged(seen)
    groups = staged(seen.where("maybe").groupBy("sha").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id")).where("group_size > 1"))
    single = lambda df: df.select("doc_id", "sha", F.lit(1).cast("long").alias("group_size"), F.col("doc_id").alias("keep_id"))
    joined = join_groups(seen.where("maybe").select("doc_id", "sha"), groups, ["sha"], "group_size", total)
    repeated = joined.where("group_size is not null").unionByName(single(joined.where("group_size is null")))
    out = repeated.unionByName(single(seen.where("not maybe")))
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
