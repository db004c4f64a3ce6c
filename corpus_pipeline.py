"""Corpus pipeline over documents: language ID, near-duplicate removal, decontamination, mixing, sharding.

Every stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and reread as the next
stage's docs. All stages but the last return the columns of documents, whatever further ones there are and however they
are called. Texts stay where they are: a stage decides in the row, or takes the decision from a filter of bounded size;
only rows whose filter slot holds several decisions shuffle. An empty table gives an empty one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import free_name, shared_dir, staged, table, with_decision
from lodestrata.llm.decontamination import without_copies
from lodestrata.llm.jaccard_join import jaccard_components
from lodestrata.llm.language_id import held_out, in_a_language, train
from lodestrata.llm.mixing import mix
from lodestrata.llm.sharding import shard

#: A document of a lower posterior is rejected with those in which no language is found.
LEAST_SCORE = 0.5
#: What a decision says of a row, besides 1, that it stays: it goes, or its doc_id is null or another row's too.
GOES, SHARED = 0, 2


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and empty texts too), or of no clear language, go. A model is learned from the
    stage's own labelled rows. Each row is decided on its own text: repeated rows alike, null ids like others."""
    langs, logp = train(docs.where(~held_out()))
    return in_a_language(docs, langs, logp, LEAST_SCORE)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, that with the smallest doc_id (five-word shingles, similarity 0.8).

    Null and empty texts link with nothing and stay. Rows that share a doc_id are one document: one of them stays, the
    first in order of text. Rows without a doc_id are no copies of rows with one; of those of equal text one stays.
    """
    component = F.col("component_id")
    value = F.when(F.count("*") > 1, SHARED).when(F.col("doc_id").isNull(), SHARED).otherwise(1)
    found = jaccard_components(docs, 5, 80).groupBy("doc_id").agg(F.min(component).alias("component_id"), value.alias("n"))
    found = staged(found.select("doc_id", F.when(F.coalesce(F.col("component_id") < F.col("doc_id"), F.lit(False)), F.lit(GOES)).otherwise(F.col("n")).alias("value")))
    name = free_name("decided", docs.columns)
    rows = with_decision(docs, found, found.count(), name=name)
    # Null ids are told apart by text, repeated ones are one document.
    key, row = free_name("key", docs.columns), free_name("row", docs.columns)
    shared = rows.where(F.col(name) == SHARED).withColumn(key, F.when(F.col("doc_id").isNull(), F.sha2(F.coalesce("text", F.lit("")), 256)))
    one = shared.groupBy("doc_id", key).agg(F.min_by(F.struct(*docs.columns), F.coalesce("text", F.lit(""))).alias(row))
    return rows.where(F.col(name) == 1).select(*docs.columns).unionByName(one.select(f"{row}.*"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go. Each row is decided on its own text; null and empty texts stay."""
    return without_copies(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; those it never takes go (null and empty texts as others: their size is
    0, their source's rate counts). Rows that share a doc_id (or have none) are all taken as often as the most taken of
    them."""
    copies = staged(mix(docs).groupBy("doc_id").agg(F.max("copies").alias("value")))
    name = free_name("copies", docs.columns)
    rows = with_decision(docs, copies, copies.count(), name=name).where(F.col(name) > 0)
    copy = free_name("copy", docs.columns)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(name)))).select(*docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of the mix."""
    return shard(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("jaccard_join", dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Language ID, links and alignment are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
