"""Queries over the index jobs, the logs, the feedback round and the builds."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import replies, rust
from ..operators import feedback as fb
from ..operators import graph, index, logs, retrieve, snapshots
from ..sources import views as v
from ..sources.views import BUILDS_SQL, CHUNKS_SQL, EDGES_SQL, FEEDBACK_LOG_SQL, INCIDENTS_SQL, RUST_SQL, SYMBOLS_SQL
from .queries import BOOSTS, BUDGET, GATE, SCORED, SQL_GATE, START, _scored, query


def _store(spark, d) -> snapshots.SnapshotStore:
    graph.stage(spark.range(1))  # sets the shared folder where it is unset
    return snapshots.SnapshotStore(spark, f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/index-{uuid.uuid4().hex}")


def _modes(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "relation", F.array_join("usage_modes", ",").alias("modes"))


# Index.


@query("SELECT src, dst, relation, modes FROM re WHERE a % 2 = 1 AND b % 2 = 1", RUST_SQL)
def index_rebuild(spark, d):
    """Two builds, the second rolled back: the edges of the first, of the odd files."""
    store, files = _store(spark, d), v.rust_files(spark, d)
    index.rebuild(files.where("k % 2 = 1"), store, commit="a")
    index.rebuild(files, store, commit="b")
    store.rollback()
    return _modes(index.replay(store)[1])


@query("SELECT src, dst, relation, modes FROM re WHERE a % 10 <> 1 AND b % 10 <> 1 AND NOT (a % 10 <> 0 AND b % 10 = 0)", RUST_SQL)
def index_ingest(spark, d):
    """Files of every tenth part are added to a build, others deleted; unchanged files don't see new names."""
    store, files = _store(spark, d), v.rust_files(spark, d)
    index.rebuild(files.where("k % 10 <> 0"), store)
    changes = files.where("k % 10 < 2").select("path", F.when(F.col("k") % 10 == 0, "changed").otherwise("deleted").alias("status"))
    index.ingest(changes, files, store, commit="c")
    return _modes(store.load("edges"))


@query("SELECT (SELECT count(*) FROM rc) + (SELECT count(*) FROM rf) AS chunks, (SELECT count(*) FROM re) AS edges, (SELECT count(*) FROM rc) AS nodes, (SELECT count(*) FROM rc) + (SELECT count(*) FROM rf) AS vectors", RUST_SQL)
def index_replay(spark, d):
    store = _store(spark, d)
    index.rebuild(v.rust_files(spark, d), store)
    n = {t: store.load(t).count() for t in ("chunks", "edges", "nodes", "vectors")}
    return spark.createDataFrame([tuple(n.values())], ", ".join(f"{t} long" for t in n))


@query("""SELECT symbol_id, kind, (SELECT coalesce(string_agg(dst, ',' ORDER BY dst), '') FROM re WHERE src = symbol_id AND relation = 'calls') AS calls, (SELECT coalesce(string_agg(dst, ',' ORDER BY dst), '') FROM re WHERE src = symbol_id AND relation = 'uses') AS uses FROM rc""", RUST_SQL)
def graph_nodes(spark, d):
    c = graph.stage(rust.chunk_files(v.rust_files(spark, d)))
    return index.node_rows(c, graph.stage(index.edges_of(c))).select("symbol_id", "kind", F.array_join("calls", ",").alias("calls"), F.array_join("uses", ",").alias("uses"))


@query("SELECT symbol_id, row_number() OVER (ORDER BY file_path, x = 'S', x)::BIGINT AS place FROM rc WHERE k % 10 = 3", RUST_SQL)
def modified_symbols(spark, d):
    rows = index.modified_symbols(v.rust_files(spark, d).where("k % 10 = 3"))
    return rows.select("symbol_id", F.row_number().over(Window.orderBy("place")).cast("long").alias("place"))


@query("SELECT path, CASE substr(module, 1, 7) WHEN 'Brand11' THEN 'auth' ELSE '' END AS domain, 'T' || (k % 7) AS imported FROM rf", RUST_SQL)
def import_domains(spark, d):
    f = v.rust_files(spark, d)
    return f.select("path", F.when(F.col("path").contains("/Brand11"), rust.domain(F.replace("path", F.lit("Brand11"), F.lit("auth")))).otherwise(rust.domain(F.col("path"))).alias("domain"), F.map_keys(rust.import_map(F.col("source")))[0].alias("imported"))


@query("""SELECT src, dst, relation FROM edges WHERE src NOT IN (SELECT src FROM uses WHERE dst LIKE 'p:1%')
    UNION ALL SELECT src, 'p:0', 'uses' FROM (SELECT DISTINCT src FROM uses WHERE dst LIKE 'p:1%')""", EDGES_SQL)
def replace_by_source(spark, d):
    e = v.edges(spark, d).select("src", "dst", "relation")
    new = v.uses(spark, d).where(F.col("dst").startswith("p:1")).select("src", F.lit("p:0").alias("dst"), F.lit("uses").alias("relation")).distinct()
    return snapshots.replace_by(e, new, ["src"])


@query("SELECT symbol_id, round(('0x' || substr(sha256('module: ' || symbol_id || chr(10) || content), 1, 2))::INT / 255.0::DOUBLE * 2 - 1, 6) AS e0 FROM (SELECT file_path AS symbol_id, arg_max(content, (symbol_id, doc_id)) AS content FROM chunks GROUP BY file_path)", CHUNKS_SQL)
def embedded_last_wins(spark, d):
    """A vector per symbol; of several chunks of one the last counts."""
    c = v.chunks(spark, d).select(F.col("file_path").alias("symbol_id"), F.col("symbol_id").alias("file_path"), F.col("doc_id").cast("int").alias("start_line"), "content")
    return index.embedded(c).select("symbol_id", F.round(F.col("embedding")[0], 6).alias("e0"))


@query("SELECT DISTINCT substr('CodeChunk_' || regexp_replace(file_path || '/a-very-long-name-of-a-branch-that-is-cut-somewhere', '[^A-Za-z0-9_]', '_', 'g'), 1, 63) AS collection FROM chunks", CHUNKS_SQL)
def branch_collections(spark, d):
    return v.chunks(spark, d).select(index.branch_name(F.concat("file_path", F.lit("/a-very-long-name-of-a-branch-that-is-cut-somewhere"))).alias("collection")).distinct()


@query(f"""SELECT way, other, min(hop) AS hop, modes FROM (
    SELECT 'upstream' AS way, src AS other, 1 AS hop, '' AS modes FROM calls WHERE dst = '{START}' UNION ALL SELECT 'downstream', dst, 1, '' FROM calls WHERE src = '{START}'
    UNION ALL SELECT 'used_by', src, 1, array_to_string(modes, ',') FROM uses WHERE dst = '{START}' UNION ALL SELECT 'uses', dst, 1, array_to_string(modes, ',') FROM uses WHERE src = '{START}'
    UNION ALL SELECT 'upstream', a.src, 2, '' FROM calls a JOIN calls b ON a.dst = b.src WHERE b.dst = '{START}' UNION ALL SELECT 'used_by', a.src, 2, array_to_string(b.modes, ',') FROM uses a JOIN uses b ON a.dst = b.src WHERE b.dst = '{START}') GROUP BY ALL""", EDGES_SQL)
def deep_neighbours(spark, d):
    """Two steps in each direction."""
    return graph.deep_neighbours(v.edges(spark, d), START, 2).select("way", "other", "hop", F.array_join("usage_modes", ",").alias("modes"))


@query("SELECT dst AS symbol_id, sum(CASE mode WHEN 'pattern_match' THEN 3 WHEN 'construction' THEN 2 ELSE 1 END)::BIGINT AS weight FROM (SELECT dst, unnest(modes) AS mode FROM uses) GROUP BY dst", EDGES_SQL)
def mode_weights(spark, d):
    w = F.create_map(*(F.lit(x) for kv in graph.MODE_WEIGHTS.items() for x in kv))
    return graph.mode_histogram(v.edges(spark, d)).groupBy("symbol_id").agg(F.sum(F.col("n") * w[F.col("mode")]).alias("weight"))


# Retrieval.


NEAR3 = """(SELECT a.vec_id AS query, b.vec_id AS match, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM (SELECT * FROM embeddings WHERE label = 1) a JOIN embeddings b ON a.vec_id <> b.vec_id
    QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) <= 3)"""


@query(f"SELECT * FROM {NEAR3}")
def nearest_resolutions(spark, d):
    e = v.read(spark, d, "embeddings")
    return retrieve.nearest(e, e.where("label = 1"), 3).select("query", "match", F.round("score", 6).alias("score"))


@query("SELECT symbol_id, score FROM (SELECT symbol_id, score FROM sc WHERE doc_id % 2 = 0 UNION ALL SELECT symbol_id, round(score / 2, 4) FROM sc WHERE doc_id % 3 = 0) ORDER BY score DESC, symbol_id LIMIT 30", SCORED)
def merged_collections(spark, d):
    s = _scored(spark, d)
    return retrieve.merged([s.where("doc_id % 2 = 0").select("symbol_id", "score"), s.where("doc_id % 3 = 0").select("symbol_id", F.round(F.col("score") / 2, 4).alias("score"))], 30)


@query("SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, t AS term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(content), '[a-z]+')) AS t FROM chunks) GROUP BY ALL) GROUP BY term", CHUNKS_SQL)
def posting_stats(spark, d):
    return retrieve.postings(v.chunks(spark, d)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("""SELECT file_path, why FROM own UNION ALL SELECT file_path, 'sibling' FROM near WHERE (SELECT sum(shown) FROM chosen) < 0.7 * 30000""",
       SCORED + BUDGET + """, own AS (SELECT DISTINCT file_path, 'chosen' AS why FROM chosen), near AS (SELECT DISTINCT file_path FROM chunks WHERE split_part(file_path, '/', 1) IN (SELECT split_part(file_path, '/', 1) FROM own) AND file_path NOT IN (SELECT file_path FROM own) ORDER BY file_path LIMIT 6)""")
def context_files(spark, d):
    """The budgeted files and their siblings; these chunks have no edges."""
    chosen = retrieve.within_budget(_scored(spark, d), 30_000)
    return retrieve.with_company(chosen, v.chunks(spark, d), v.edges(spark, d), v.symbols(spark, d), 30_000)


@query("SELECT symbol_id, round(CASE doc_id % 3 WHEN 0 THEN least(score * 1.6::DOUBLE, 1) WHEN 1 THEN score * 0.2::DOUBLE ELSE score END, 6) AS score FROM sc", SCORED)
def kind_factors(spark, d):
    kind = F.when(F.col("doc_id") % 3 == 0, "file_summary").when(F.col("doc_id") % 3 == 1, "module_exports").otherwise("fn")
    return retrieve.kind_factor(_scored(spark, d).withColumn("kind", kind)).select("symbol_id", F.round("score", 6).alias("score"))


@query("SELECT id AS session_id, 'fail ' || id AS semantic_query, 4 AS symbols, (SELECT min(symbol_id) FROM chunks) IS NOT NULL AS has_primary FROM (SELECT unnest(range(1, 4)) AS id)", CHUNKS_SQL)
def incident_contexts(spark, d):
    f = spark.createDataFrame([(k, "fail", str(k), "", "") for k in range(1, 4)], "session_id long, service string, panic_type string, top_frame string, commit_hash string")
    out = replies.contexts(f, v.chunks(spark, d), v.edges(spark, d), 2)
    return out.select("session_id", F.trim("semantic_query").alias("semantic_query"), F.size("indexed_symbols").alias("symbols"), F.col("primary_symbol").isNotNull().alias("has_primary"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'r' ELSE 'Model did not provide a root cause.' END AS root_cause, CASE WHEN turn % 2 = 0 THEN 'a=1' ELSE 'LLM=0.50' END AS confidence FROM conversations")
def reply_projection(spark, d):
    said = F.when(F.col("turn") % 2 == 0, 'So: ```json\n{"root_cause": "r", "confidence": [{"label": "a", "value": 1}]}\n```').otherwise("nothing")
    r = v.read(spark, d, "conversations").select("conv_id", "turn", replies.analysis(said).alias("a"))
    return r.select("conv_id", "turn", "a.root_cause", F.array_join(F.transform("a.confidence", lambda x: F.concat_ws("=", x["label"], x["value"])), ",").alias("confidence"))


# Feedback and builds.


@query("SELECT symbol_id, boost FROM boosts WHERE boost <> 0", BOOSTS)
def nonzero_boosts(spark, d):
    return fb.nonzero_boosts(fb.boost_weights(v.votes(spark, d))).select("symbol_id", "boost")


@query("SELECT feedback_id, now_status AS status, now_score AS score FROM ev", GATE + FEEDBACK_LOG_SQL)
def evaluated_feedback(spark, d):
    return fb.evaluate_pending(v.feedback_log(spark, d), gate=SQL_GATE).select("feedback_id", "status", "score")


@query("SELECT feedback_id, old_score AS score FROM flog WHERE status = 'accepted' AND NOT consumed ORDER BY old_score DESC, created, feedback_id LIMIT 20", GATE + FEEDBACK_LOG_SQL)
def unconsumed_feedback(spark, d):
    return fb.unconsumed(v.feedback_log(spark, d), 20).select("feedback_id", "score")


TAKEN = GATE + FEEDBACK_LOG_SQL + ", taken AS (SELECT * FROM ev WHERE now_status = 'accepted' AND NOT consumed ORDER BY now_score DESC, created, feedback_id LIMIT 50)"
SIGNAL = "avg((CASE WHEN coalesce(rating, 0) = 0 THEN 3 ELSE rating END - 3) / 2.0::DOUBLE * CASE WHEN now_score = 0 THEN 0.5::DOUBLE ELSE now_score END + CASE WHEN helpful THEN 0.3::DOUBLE WHEN NOT helpful THEN -0.3::DOUBLE ELSE 0 END)"


@query(f"SELECT symbol_id, CASE WHEN round({SIGNAL}, 6) > 0 THEN 1 ELSE -1 END AS vote FROM taken GROUP BY symbol_id", TAKEN)
def feedback_round_votes(spark, d):
    """What a round of the loop adds to the votes."""
    return fb.tick(graph.stage(v.feedback_log(spark, d)), "b2", datetime.datetime(2024, 1, 1), gate=SQL_GATE)[1].select("symbol_id", "vote")


@query("SELECT feedback_id, now_status AS status, CASE WHEN feedback_id IN (SELECT feedback_id FROM taken) THEN 'b2' WHEN consumed THEN 'b1' END AS consumed_by FROM ev", TAKEN)
def feedback_round_state(spark, d):
    return fb.tick(graph.stage(v.feedback_log(spark, d)), "b2", datetime.datetime(2024, 1, 1), gate=SQL_GATE)[0].select("feedback_id", "status", "consumed_by")


@query("SELECT n AS unconsumed, CASE WHEN n >= 10 THEN 'rebuild' WHEN n >= 5 THEN 'rerank' ELSE 'nothing' END AS due FROM (SELECT count(*) AS n FROM ev WHERE now_status = 'accepted' AND NOT consumed)", GATE + FEEDBACK_LOG_SQL)
def feedback_round_due(spark, d):
    return fb.tick(graph.stage(v.feedback_log(spark, d)), None, None, gate=SQL_GATE)[2]


LAST_OPEN = "(SELECT max(build_id) FROM builds WHERE status = 'building')"


@query(f"""SELECT build_id, CASE WHEN build_id = {LAST_OPEN} THEN 'completed' WHEN status = 'completed' AND repo = (SELECT repo FROM builds WHERE build_id = {LAST_OPEN}) THEN 'superseded' ELSE status END AS status,
    CASE WHEN build_id = {LAST_OPEN} THEN 0.75 ELSE quality_score END AS quality_score FROM builds""", BUILDS_SQL)
def build_completed(spark, d):
    b = graph.stage(v.builds(spark, d))
    last = b.where("status = 'building'").agg(F.max("build_id")).first()[0]
    return fb.with_quality(fb.complete(b, last), last, 0.75).select("build_id", "status", "quality_score")


@query("SELECT 'new' || repo AS build_id, parent_id::VARCHAR AS parent_id, 'building' AS status FROM (SELECT repo, arg_max(build_id, (created_at, build_id)) FILTER (status = 'completed') AS parent_id FROM builds WHERE repo % 10 = 0 GROUP BY repo)", BUILDS_SQL)
def build_registered(spark, d):
    b = v.builds(spark, d).withColumn("build_id", F.format_string("%012d", "build_id")).withColumn("parent_id", F.format_string("%012d", "parent_id"))
    b = graph.stage(b)
    new = b.where("repo % 10 = 0").groupBy("repo").agg(F.max("created_at").alias("created_at")).select("repo", F.concat(F.lit("new"), F.col("repo").cast("string")).alias("build_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("").alias("status"), F.lit(0.0).alias("quality_score"), "created_at")
    return fb.register(b, new).where(F.col("build_id").startswith("new")).select("build_id", F.regexp_replace("parent_id", "^0+", "").alias("parent_id"), "status")


@query("SELECT build_id, status FROM builds ORDER BY created_at DESC, build_id DESC LIMIT 20", BUILDS_SQL)
def build_history(spark, d):
    return fb.history(v.builds(spark, d)).select("build_id", "status")


# Logs.


def _incident_log(spark, d) -> DataFrame:
    return v.incident_events(spark, d).withColumn("created_at", F.col("ts").cast("timestamp")).withColumn("event_type", F.lower("state")).withColumn("payload", F.to_json(F.struct(F.col("value").alias("root_cause"))))


@query("SELECT session_id, arg_max(state, (ts, event_id)) AS state, count(*) AS events FROM incident_events GROUP BY session_id ORDER BY max(ts) DESC, session_id LIMIT 50", INCIDENTS_SQL)
def sessions_by_update(spark, d):
    return logs.sessions(_incident_log(spark, d)).limit(50).select("session_id", "state", "events")


@query("""SELECT session_id, step::INT AS step, s AS state, 'analysis_' || CASE s WHEN 'VALIDATING' THEN 'ready' ELSE lower(s) END AS event_type FROM (SELECT session_id, unnest(range(6 - pos)) AS step, unnest(c[pos + 1:6]) AS s FROM
    (SELECT session_id, ['CREATED', 'INGESTING', 'RETRIEVING', 'GRAPH_EXPANDING', 'GENERATING_PATCH', 'VALIDATING'] AS c, list_position(c, arg_max(state, (ts, event_id))) AS pos FROM incident_events GROUP BY session_id) WHERE pos IS NOT NULL)""", INCIDENTS_SQL)
def analysis_steps(spark, d):
    """The events that an analysis of every open session would add."""
    return logs.analysis_events(logs.sessions(_incident_log(spark, d)).select("session_id", "state"))


@query("SELECT count(*) AS created, 0::BIGINT AS resolved, count(*) FILTER (state = 'FAILED') AS failed FROM (SELECT arg_max(state, (ts, event_id)) AS state FROM incident_events GROUP BY session_id)", INCIDENTS_SQL)
def session_outcomes(spark, d):
    return logs.resolution_effects(_incident_log(spark, d))[2]


@query("SELECT event_type AS case_id, arg_max(event_id, ts) AS version FROM (SELECT * FROM events WHERE user_id % 3 = 0) GROUP BY event_type")
def eval_case_versions(spark, d):
    """The last version of each case in an environment."""
    e = v.read(spark, d, "events").select(F.concat_ws("/", F.col("user_id") % 3, "event_type").alias("case_id"), F.col("event_id").alias("version"), (F.col("user_id") % 3).cast("string").alias("environment"), F.col("ts").alias("created_at"))
    return logs.eval_cases(e, "0").select(F.substring_index("case_id", "/", -1).alias("case_id"), "version")


@query("SELECT conv_id AS thread_id, count(*) - 1 AS messages, 'title ' || conv_id AS title FROM conversations WHERE conv_id % 4 <> 0 GROUP BY conv_id")
def thread_list(spark, d):
    """Threads whose first turn creates them; every fourth is deleted by its end."""
    c = v.read(spark, d, "conversations")
    ends = c.groupBy("conv_id").agg(F.max("turn").alias("last"), F.min("turn").alias("first"))
    at = lambda turn: F.timestamp_seconds(F.col(turn).cast("long"))
    op = c.join(ends, "conv_id").select(F.col("conv_id").alias("thread_id"), F.when(F.col("turn") == F.col("first"), "create").otherwise("message").alias("op"), F.concat(F.lit("title "), F.col("conv_id").cast("string")).alias("title"), at("turn").alias("created_at"))
    gone = ends.where("conv_id % 4 = 0").select(F.col("conv_id").alias("thread_id"), F.lit("delete").alias("op"), F.lit(None).cast("string").alias("title"), at("last").alias("created_at"))
    return logs.threads(op.unionByName(gone)).select("thread_id", "messages", "title")


@query("""SELECT conv_id, turn FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 20) c
    WHERE NOT (role = 'user' AND text = (SELECT arg_max(text, turn) FROM conversations k WHERE k.conv_id = c.conv_id AND role = 'user'))""")
def history_without_current(spark, d):
    c = v.read(spark, d, "conversations")
    current = c.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    return logs.history(c, current).select("conv_id", "turn")


@query("""SELECT event_type, count(*) AS held, round(avg(value), 6) AS mean FROM (SELECT *, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events)
    WHERE r <= CASE WHEN n <= 100 THEN n ELSE 50 + (n - 101) % 51 END GROUP BY event_type""")
def sample_buffer(spark, d):
    return logs.buffered(v.read(spark, d, "events"), "event_type", ["ts", "event_id"], 100, 50).groupBy("event_type").agg(F.count("*").alias("held"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT 'degraded' AS status, false AS ready")
def health_rollup(spark, d):
    checks = v.read(spark, d, "region").select(F.col("r_name").alias("backend"), F.when(F.col("r_regionkey") == 0, "unhealthy").when(F.col("r_regionkey") == 1, "disabled").otherwise("healthy").alias("status"))
    return logs.health(checks)


@query("SELECT count(*) FILTER (event_type = 'click') AS hits, count(*) FILTER (event_type = 'error') AS misses, round(count(*) FILTER (event_type = 'click') / count(*) FILTER (event_type IN ('click', 'error')), 4) AS hit_rate FROM events")
def cache_hit_rate(spark, d):
    return logs.hit_rate(v.read(spark, d, "events"), "click", "error")


@query("SELECT symbol_id, kind = 'supplier' AS config FROM symbols", SYMBOLS_SQL)
def config_types(spark, d):
    named = F.concat("symbol_id", F.lit("::"), F.when(F.col("kind") == "supplier", "AppState").otherwise("Row"))
    return v.symbols(spark, d).select("symbol_id", graph.is_config_type(named).alias("config"))


@query("SELECT symbol_id AS term, count(*) AS n FROM votes WHERE vote > 0 AND symbol_id IN (SELECT symbol_id FROM boosts WHERE boost > 0) GROUP BY symbol_id", BOOSTS)
def boosted_patterns(spark, d):
    """The search patterns to append: positive votes for symbols with a boost above 0."""
    votes = graph.stage(v.votes(spark, d))
    good = fb.boost_weights(votes).where("boost > 0").select("symbol_id")
    return votes.where("vote > 0").join(good, "symbol_id", "left_semi").groupBy(F.col("symbol_id").alias("term")).agg(F.count("*").alias("n"))

