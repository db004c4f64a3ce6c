"""What a model is given about an incident, and what is taken from its reply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graph, retrieve
from .rust import parse_json_reply

#: Fixed texts of a reply without them.
NO_CAUSE, NO_PATCH, NO_CONFIDENCE = "Model did not provide a root cause.", "// TODO: model did not provide a patch", ("LLM", "0.50")


def analysis(reply: Column) -> Column:
    """struct(root_cause, patch, confidence array(label, value)) of a reply's JSON, with defaults for what it lacks."""
    j = F.from_json(parse_json_reply(reply), "root_cause string, patch string, confidence array<struct<label:string,value:string>>")
    one = F.transform(j["confidence"], lambda x: F.struct(F.coalesce(x["label"], F.lit("Unknown")).alias("label"), F.coalesce(x["value"], F.lit("0.0")).alias("value")))
    default = F.array(F.struct(F.lit(NO_CONFIDENCE[0]).alias("label"), F.lit(NO_CONFIDENCE[1]).alias("value")))
    return F.struct(F.coalesce(j["root_cause"], F.lit(NO_CAUSE)).alias("root_cause"), F.coalesce(j["patch"], F.lit(NO_PATCH)).alias("patch"), F.when(F.size(one) > 0, one).otherwise(default).alias("confidence"))


def contexts(fingerprints: DataFrame, chunks: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """A row per fingerprint(session_id, service, panic_type, top_frame, commit_hash): the query of its four fields, the
    2 * depth nearest chunks by hashed embeddings, the first as primary symbol, and the neighbours of the first depth."""
    asked = fingerprints.select("session_id", F.concat_ws(" ", "service", "panic_type", "top_frame", "commit_hash").alias("semantic_query"))
    ids = chunks.select(F.xxhash64("symbol_id").alias("key"), "symbol_id", "file_path", "content")
    every = ids.select("key", retrieve.hash_embedding(F.col("content")).alias("v"))
    near = retrieve.nearest(every, asked.select((-F.col("session_id") - 1).alias("key"), retrieve.hash_embedding(F.col("semantic_query")).alias("v")), 2 * depth, "v", "key")
    hits = near.select((-F.col("query") - 1).alias("session_id"), F.col("match").alias("key"), "score").join(ids, "key")
    hits = graph.stage(hits.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("score"), "key"))))
    listed = hits.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("place", "symbol_id", "file_path", "score", "content"))).alias("indexed_symbols"))
    few = hits.where(F.col("place") <= depth)
    around = graph.neighbours(edges.join(few.select("symbol_id").distinct(), (F.col("src") == F.col("symbol_id")) | (F.col("dst") == F.col("symbol_id")), "left_semi"))
    lists = few.join(around, "symbol_id", "left").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("place", "symbol_id", "upstream", "downstream"))).alias("graph_neighborhoods"))
    out = asked.join(listed, "session_id", "left").join(lists, "session_id", "left")
    return out.withColumn("primary_symbol", F.try_element_at("indexed_symbols", F.lit(1))["symbol_id"])


def model_input(contexts: DataFrame) -> DataFrame:
    """The part of a context that a model is given: five symbols of 400 characters, three neighbourhoods, as JSON."""
    some = F.transform(F.slice("indexed_symbols", 1, 5), lambda x: F.struct(x["symbol_id"].alias("symbol_id"), x["file_path"].alias("source"), x["score"].alias("score"), F.substring(x["content"], 1, 400).alias("content")))
    near = F.transform(F.slice("graph_neighborhoods", 1, 3), lambda x: F.struct(x["symbol_id"].alias("symbol_id"), x["upstream"].alias("upstream"), x["downstream"].alias("downstream")))
    return contexts.select("session_id", F.to_json(F.struct("semantic_query", "primary_symbol", some.alias("indexed_symbols"), near.alias("graph_neighborhoods"))).alias("input"))
