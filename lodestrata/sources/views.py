"""Domain tables as views over the star schema, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MODES = {"A": "pattern_match", "N": "construction", "R": "type_reference"}


def calls(spark: SparkSession, d: str) -> DataFrame:
    """src calls dst: suppliers and the parts of their small lines."""
    line = read(spark, d, "lineitem").where("l_quantity <= 5")
    return line.select(F.concat(F.lit("s:"), "l_suppkey").alias("src"), F.concat(F.lit("p:"), "l_partkey").alias("dst")).distinct()


def uses(spark: SparkSession, d: str) -> DataFrame:
    """src uses dst with sorted usage modes: customers and the parts of their discounted lines."""
    line = read(spark, d, "lineitem").where("l_discount >= 0.08")
    orders = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    mode = F.create_map(*(F.lit(x) for kv in MODES.items() for x in kv))[F.col("l_returnflag")]
    pairs = line.join(orders, line.l_orderkey == orders.o_orderkey)
    pairs = pairs.select(F.concat(F.lit("c:"), "o_custkey").alias("src"), F.concat(F.lit("p:"), "l_partkey").alias("dst"), mode.alias("mode"))
    return pairs.groupBy("src", "dst").agg(F.array_sort(F.collect_set("mode")).alias("usage_modes"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, relation, usage_modes) of both relations; calls carry no modes."""
    modes = F.array().cast("array<string>")
    return calls(spark, d).select("src", "dst", F.lit("calls").alias("relation"), modes.alias("usage_modes")).unionByName(uses(spark, d).select("src", "dst", F.lit("uses").alias("relation"), "usage_modes"))


EDGES_SQL = """
calls AS (SELECT DISTINCT 's:' || l_suppkey AS src, 'p:' || l_partkey AS dst FROM lineitem WHERE l_quantity <= 5),
uses AS (SELECT 'c:' || o_custkey AS src, 'p:' || l_partkey AS dst,
    list_sort(list(DISTINCT CASE l_returnflag WHEN 'A' THEN 'pattern_match' WHEN 'N' THEN 'construction' ELSE 'type_reference' END)) AS modes
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_discount >= 0.08 GROUP BY ALL),
edges AS (SELECT src, dst, 'calls' AS relation, [] AS modes FROM calls UNION ALL SELECT src, dst, 'uses', modes FROM uses)
"""


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """(symbol_id, short_name, file_path, kind) of parts, suppliers and customers."""
    part = read(spark, d, "part").select(F.concat(F.lit("p:"), "p_partkey").alias("symbol_id"), F.col("p_name").alias("short_name"), F.concat_ws("/", "p_brand", "p_type").alias("file_path"), F.col("p_type").alias("kind"))
    supplier = read(spark, d, "supplier").select(F.concat(F.lit("s:"), "s_suppkey").alias("symbol_id"), F.col("s_name").alias("short_name"), F.concat(F.lit("nation/"), "s_nationkey").alias("file_path"), F.lit("supplier").alias("kind"))
    customer = read(spark, d, "customer").select(F.concat(F.lit("c:"), "c_custkey").alias("symbol_id"), F.col("c_name").alias("short_name"), F.concat(F.lit("nation/"), "c_nationkey").alias("file_path"), F.lit("customer").alias("kind"))
    return part.unionByName(supplier).unionByName(customer)


SYMBOLS_SQL = """
symbols AS (SELECT 'p:' || p_partkey AS symbol_id, p_name AS short_name, p_brand || '/' || p_type AS file_path, p_type AS kind FROM part
    UNION ALL SELECT 's:' || s_suppkey, s_name, 'nation/' || s_nationkey, 'supplier' FROM supplier
    UNION ALL SELECT 'c:' || c_custkey, c_name, 'nation/' || c_nationkey, 'customer' FROM customer)
"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """(symbol_id, file_path, doc_id, content) of documents."""
    return read(spark, d, "documents").select(F.concat(F.lit("d:"), "doc_id").alias("symbol_id"), F.concat_ws("/", "lang", "source").alias("file_path"), "doc_id", F.col("text").alias("content"))


CHUNKS_SQL = "chunks AS (SELECT 'd:' || doc_id AS symbol_id, lang || '/' || source AS file_path, doc_id, text AS content FROM documents)"


def votes(spark: SparkSession, d: str) -> DataFrame:
    """(symbol_id, query_text, vote, event_id, ts): purchases and signups for, errors against."""
    e = read(spark, d, "events")
    vote = F.when(F.col("event_type").isin("purchase", "signup"), 1).when(F.col("event_type") == "error", -1)
    symbol = F.concat(F.lit("k:"), F.get_json_object("props", "$.k"))
    return e.select(symbol.alias("symbol_id"), F.concat_ws(" ", F.lit("query"), "event_type", F.col("user_id") % 7).alias("query_text"), vote.alias("vote"), "event_id", "ts").where("vote is not null")


VOTES_SQL = """
votes AS (SELECT 'k:' || (props->>'$.k') AS symbol_id, 'query ' || event_type || ' ' || (user_id % 7) AS query_text,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE -1 END AS vote, event_id, ts FROM events WHERE event_type IN ('purchase', 'signup', 'error'))
"""

STATES = {"view": "CREATED", "click": "INGESTING", "signup": "RETRIEVING", "purchase": "GRAPH_EXPANDING", "error": "FAILED"}


def incident_events(spark: SparkSession, d: str) -> DataFrame:
    """(session_id, event_id, state, ts, value): a session per user."""
    state = F.create_map(*(F.lit(x) for kv in STATES.items() for x in kv))[F.col("event_type")]
    return read(spark, d, "events").select(F.col("user_id").alias("session_id"), "event_id", state.alias("state"), "ts", "value")


INCIDENTS_SQL = """
incident_events AS (SELECT user_id AS session_id, event_id, CASE event_type WHEN 'view' THEN 'CREATED' WHEN 'click' THEN 'INGESTING'
    WHEN 'signup' THEN 'RETRIEVING' WHEN 'purchase' THEN 'GRAPH_EXPANDING' ELSE 'FAILED' END AS state, ts, value FROM events)
"""


def ai_feedback(spark: SparkSession, d: str) -> DataFrame:
    """Feedback rows from labelled documents: tools, mentions, rating, suggestion and expectation texts."""
    labels, size = read(spark, d, "labels"), lambda quality: (F.lit(25) * (F.col(quality) + 1)).cast("int")
    # Texts are cut before the join, to what the best quality asks for, so that whole texts aren't shuffled.
    docs = read(spark, d, "documents").join(F.broadcast(labels.agg(F.max("quality").alias("best"))))
    x = labels.join(docs.select("doc_id", F.substring("text", 1, size("best")).alias("head"), F.substring("text", 10, (F.lit(30) * (1 + F.col("doc_id") % 8)).cast("int")).alias("expected")), "doc_id")
    return x.select(
        F.col("doc_id").alias("feedback_id"), (F.col("doc_id") % 4).cast("int").alias("n_tools"), (F.col("doc_id") % 6).cast("int").alias("n_mentions"),
        F.when(F.col("doc_id") % 9 == 0, None).otherwise((F.col("doc_id") % 7)).cast("int").alias("rating"),
        F.substring("head", 1, size("quality")).alias("suggestions"), "expected",
        F.concat(F.lit("k:"), F.col("doc_id") % 50).alias("symbol_id"), F.when(F.col("toxic") == 1, F.lit(False)).when(F.col("quality") == 1, F.lit(True)).alias("helpful"),
    )


FEEDBACK_SQL = """
fb AS (SELECT doc_id AS feedback_id, (doc_id % 4)::INT AS n_tools, (doc_id % 6)::INT AS n_mentions, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE (doc_id % 7)::INT END AS rating,
    substr(text, 1, 25 * (quality + 1)) AS suggestions, substr(text, 10, (30 * (1 + doc_id % 8))::INT) AS expected, 'k:' || (doc_id % 50) AS symbol_id,
    CASE WHEN toxic = 1 THEN false WHEN quality = 1 THEN true END AS helpful FROM labels JOIN documents USING (doc_id))
"""


def builds(spark: SparkSession, d: str) -> DataFrame:
    """(build_id, parent_id, status, quality_score, created_at, chunk_count): each order follows the customer's one before."""
    o = read(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "building").otherwise("failed")
    return o.select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("build_id"), F.lag("o_orderkey").over(w).alias("parent_id"), status.alias("status"), F.round(F.col("o_orderkey") % 1000 / 1000, 3).alias("quality_score"), F.col("o_orderdate").alias("created_at"))


BUILDS_SQL = """
builds AS (SELECT o_custkey AS repo, o_orderkey AS build_id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent_id,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'building' ELSE 'failed' END AS status, round(o_orderkey % 1000 / 1000.0::DOUBLE, 3) AS quality_score, o_orderdate AS created_at FROM orders)
"""


def rust_files(spark: SparkSession, d: str) -> DataFrame:
    """(path, source, k): a Rust file per part, with a function that calls another file's, a helper, and a struct that uses the next."""
    k, nxt = F.col("p_partkey").cast("string"), (F.col("p_partkey") + 1).cast("string")
    text = F.format_string("use crate::base::T%s;\n\n/// Part %s.\npub fn f%s(n: u64) -> u64 {\n    g%s(n) + f%s(n)\n}\n\npub fn g%s(n: u64) -> u64 { n + 1 + 2 + 3 }\n\npub struct S%s {\n    pub first: S%s,\n    pub second: u64,\n}\n", (F.col("p_partkey") % 7).cast("string"), k, k, (F.col("p_partkey") % 50).cast("string"), nxt, k, k, nxt)
    part = read(spark, d, "part").select("p_partkey", "p_brand").repartition("p_partkey")  # a few MB of parts become many of source
    return part.select(F.concat(F.lit("src/"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("/p"), k, F.lit(".rs")).alias("path"), text.alias("source"), F.col("p_partkey").alias("k"))


RUST_SQL = """
rf AS (SELECT p_partkey AS k, 'src/' || replace(p_brand, '#', '') || '/p' || p_partkey || '.rs' AS path, replace(p_brand, '#', '') || '::p' || p_partkey AS module FROM part),
rc AS (SELECT module || '::' || x || k AS symbol_id, path AS file_path, CASE x WHEN 'S' THEN 'struct' ELSE 'fn' END AS kind, x, k FROM rf, (SELECT unnest(['f', 'g', 'S']) AS x)),
re AS (SELECT a.symbol_id AS src, b.symbol_id AS dst, CASE a.x WHEN 'f' THEN 'calls' ELSE 'uses' END AS relation, CASE a.x WHEN 'f' THEN '' ELSE 'field_declaration' END AS modes, a.k AS a, b.k AS b
    FROM rc a JOIN rc b ON a.x = 'f' AND b.x = 'g' AND b.k = a.k % 50 OR a.x = b.x AND a.x <> 'g' AND b.k = a.k + 1)
"""


def diffs(spark: SparkSession, d: str) -> DataFrame:
    """(diff_id, text): a changed signature and a new function in the files of small parts."""
    f = rust_files(spark, d).join(read(spark, d, "part").where("p_size <= 3").select(F.col("p_partkey").alias("k")), "k")
    text = F.format_string("diff --git a/%s b/%s\n--- a/%s\n+++ b/%s\n@@ -4 +4,4 @@\n-pub fn f%s(n: u64) -> u64 {\n+pub fn f%s(n: u64, m: u64) -> u64 {\n+pub fn added%s() {\n+}\n", "path", "path", "path", "path", F.col("k").cast("string"), F.col("k").cast("string"), F.col("k").cast("string"))
    return f.select(F.col("k").alias("diff_id"), text.alias("text"))


def feedback_log(spark: SparkSession, d: str) -> DataFrame:
    """Feedback with a life: two thirds pending, some accepted, some of these consumed."""
    f, i = ai_feedback(spark, d), F.col("feedback_id")
    status = F.when(i % 3 < 2, "pending").otherwise("accepted")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + i * 7919 % 100_000)
    return f.withColumn("status", status).withColumn("score", F.when(status == "accepted", F.round(i % 50 / 100 + 0.5, 2))).withColumn("created_at", at).withColumn("consumed_at", F.when((status == "accepted") & (i % 2 == 0), at)).withColumn("consumed_by", F.when((status == "accepted") & (i % 2 == 0), "b1"))


FEEDBACK_LOG_SQL = """, flog AS (SELECT * EXCLUDE (status, score), feedback_id % 3 < 2 AS pending, CASE WHEN feedback_id % 3 < 2 THEN 'pending' ELSE 'accepted' END AS status, CASE WHEN feedback_id % 3 = 2 THEN round(feedback_id % 50 / 100.0::DOUBLE + 0.5, 2) END AS old_score,
    feedback_id * 7919 % 100000 AS created, feedback_id % 3 = 2 AND feedback_id % 2 = 0 AS consumed, score AS new_score, status AS new_status FROM gate),
ev AS (SELECT *, CASE WHEN chosen THEN new_status ELSE status END AS now_status, CASE WHEN chosen THEN new_score ELSE old_score END AS now_score FROM
    (SELECT *, pending AND row_number() OVER (PARTITION BY pending ORDER BY created, feedback_id) <= 50 AS chosen FROM flog))"""
