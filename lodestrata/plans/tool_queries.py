"""Queries that call the tools over the star schema's catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rust
from ..operators import graph
from ..sources import views as v
from ..sources.views import EDGES_SQL, SYMBOLS_SQL
from ..tools import Catalog, call
from . import samples
from .queries import BOOSTS, DEGREES, HOPS, START, query


def catalog(spark, d) -> Catalog:
    """Chunks bear the ids that votes name, so that search meets boosts."""
    chunks = v.chunks(spark, d).withColumn("symbol_id", F.concat(F.lit("k:"), "doc_id"))
    return Catalog(v.symbols(spark, d), chunks, v.edges(spark, d), v.votes(spark, d))


@query(f"""SELECT symbol_id, upstream AS total_upstream, used_by AS total_used_by, total AS total_connections, risk, s.kind, s.file_path,
    (SELECT coalesce(array_to_string(list_sort(list(src))[1:50], ','), '') FROM calls WHERE dst = '{START}') AS upstream,
    (SELECT coalesce(string_agg(src, ',' ORDER BY src) FILTER (list_contains(modes, 'construction')), '') FROM (SELECT * FROM uses WHERE dst = '{START}' ORDER BY src LIMIT 50)) AS used_by
    FROM blast JOIN symbols s USING (symbol_id) WHERE symbol_id = '{START}'""", DEGREES.strip() + "," + SYMBOLS_SQL)  # fmt: skip
def tool_blast_radius(spark, d):
    found = call(catalog(spark, d), "get_blast_radius", symbol_id=START, usage_modes_filter=["construction"])
    return found.select("symbol_id", "total_upstream", "total_used_by", "total_connections", "risk", "kind", "file_path", "upstream", "used_by")


SOME = ["p:1", "p:2", "s:1", "c:3", "absent"]


@query(f"""SELECT callers, callees, type_users, types_used, CASE WHEN callers + callees + type_users + types_used > 100 OR callers + type_users > 20 THEN 'critical'
    WHEN callers + callees + type_users + types_used > 40 OR callers + type_users > 10 THEN 'high' WHEN callers + callees + type_users + types_used > 10 OR callers + type_users > 3 THEN 'medium' ELSE 'low' END AS risk FROM
    (SELECT count(DISTINCT src) FILTER (relation = 'calls' AND dst IN {tuple(SOME)} AND src NOT IN {tuple(SOME)}) AS callers, count(DISTINCT dst) FILTER (relation = 'calls' AND src IN {tuple(SOME)} AND dst NOT IN {tuple(SOME)}) AS callees,
    count(DISTINCT src) FILTER (relation = 'uses' AND dst IN {tuple(SOME)} AND src NOT IN {tuple(SOME)}) AS type_users, count(DISTINCT dst) FILTER (relation = 'uses' AND src IN {tuple(SOME)} AND dst NOT IN {tuple(SOME)}) AS types_used FROM edges)""", EDGES_SQL)  # fmt: skip
def tool_combined_impact(spark, d):
    return call(catalog(spark, d), "combined_impact", symbol_ids=SOME)


@query(f"SELECT symbol_id, total AS total_connections, callers, callees, risk FROM blast WHERE symbol_id IN {tuple(SOME)}", DEGREES)
def tool_batch_blast_radius(spark, d):
    return call(catalog(spark, d), "batch_blast_radius", symbol_ids=SOME).select("symbol_id", "total_connections", "callers", "callees", "risk")


@query("SELECT symbol_id, hop, upstream, downstream, used_by, uses FROM hops JOIN deg ON id = symbol_id WHERE hop <= 1", HOPS + "," + DEGREES[len(EDGES_SQL):].strip().lstrip(","))
def tool_traverse_graph(spark, d):
    return call(catalog(spark, d), "traverse_graph", symbol_id=START, depth=2, summary_only=True)


SAID = "query purchase 3"
HASHED = "[('0x' || substr(sha256({}), 2 * i + 1, 2))::INT / 255.0::DOUBLE * 2 - 1 FOR i IN range(16)]"


@query(f"""SELECT symbol_id, round(s + 0.15::DOUBLE * coalesce(boost, 0), 4) AS score, round(s, 4) AS original_score, coalesce(boost, 0) AS boost FROM
    (SELECT 'k:' || doc_id AS symbol_id, round(list_cosine_similarity({HASHED.format('text')}, q), 9) AS s FROM documents, (SELECT {HASHED.format('said')} AS q FROM
    (SELECT '{SAID}' || coalesce((SELECT ' ' || string_agg(term, ' ' ORDER BY weight DESC, term) FROM (SELECT * FROM weights WHERE query_text = '{SAID}' AND weight > 1 ORDER BY weight DESC, term LIMIT 5)), '') AS said)) ORDER BY s DESC, symbol_id LIMIT 20)
    LEFT JOIN (SELECT symbol_id, round(boost, 4) AS boost FROM boosts) USING (symbol_id) ORDER BY 2 DESC, 1 LIMIT 10""", BOOSTS)  # fmt: skip
def tool_semantic_search(spark, d):
    return call(catalog(spark, d), "semantic_search", query=SAID).select("symbol_id", "score", "original_score", "boost")


@query()
def tool_analyze_pr_diff(spark, d):
    files = spark.createDataFrame(samples.FILES, "path string, source string")
    c = rust.chunk_files(files, summaries=False)
    symbols = c.select("symbol_id", rust.short_name(F.col("symbol_id")).alias("short_name"), "file_path", "kind")
    known = Catalog(symbols, c, graph.stage(rust.call_edges(c).unionByName(rust.use_edges(c))), v.votes(spark, d))
    return call(known, "analyze_pr_diff", diff_text=samples.DIFFS[0][1])


@query(f"""SELECT file_path, count(DISTINCT other) AS neighbours FROM (SELECT dst AS other FROM edges WHERE src = '{START}' UNION SELECT src FROM edges WHERE dst = '{START}')
    JOIN symbols ON symbol_id = other GROUP BY file_path ORDER BY 2 DESC, 1 LIMIT 20""", EDGES_SQL + "," + SYMBOLS_SQL)  # fmt: skip
def neighbour_files(spark, d):
    """Files that hold most neighbours of a symbol."""
    return graph.neighbour_files(v.edges(spark, d), v.symbols(spark, d), START)


@query("""SELECT dir, array_to_string(list(name ORDER BY name)[1:6], ', ') || CASE WHEN count(*) > 8 THEN ' ... +' || (count(*) - 6) || ' more' WHEN count(*) > 6 THEN ', ' || array_to_string(list(name ORDER BY name)[7:8], ', ') ELSE '' END AS line
    FROM (SELECT DISTINCT split_part(file_path, '/', 1) AS dir, split_part(file_path, '/', 2) AS name FROM symbols) GROUP BY dir""", SYMBOLS_SQL)  # fmt: skip
def directory_tree(spark, d):
    return graph.directory_lines(v.symbols(spark, d).select("file_path").distinct())
