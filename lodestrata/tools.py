"""The tools of the engine: a name and arguments -> DataFrame, over the tables of a Catalog.

Every tool first narrows the edges to the symbols it is asked about, so that the filter reaches the scan. Limits are
clamped as the tools' schemas state. An unknown symbol gives no rows; an unknown tool or feedback value is an error.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import diff
from .operators import feedback as fb
from .operators import graph, retrieve

#: Weight of a symbol's boost in search, and the most characters of a query that a query-level vote carries.
ALPHA, QUERY_KEY = 0.15, 80
TOOLS: dict[str, Callable[..., DataFrame]] = {}


@dataclass(frozen=True)
class Catalog:
    """symbols(symbol_id, short_name, file_path, kind), chunks(symbol_id, file_path, content), edges(src, dst, relation,
    usage_modes), votes(symbol_id, query_text, vote)."""

    symbols: DataFrame
    chunks: DataFrame
    edges: DataFrame
    votes: DataFrame

    def as_views(self) -> None:
        """The tables as temporary views, for spark.sql."""
        for f in fields(self):
            getattr(self, f.name).createOrReplaceTempView(f.name)


def tool(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    TOOLS[f.__name__] = f
    return f


def call(catalog: Catalog, name: str, **arguments) -> DataFrame:
    if name not in TOOLS:
        raise KeyError(f"unknown tool: {name}")
    return TOOLS[name](catalog, **arguments)


def clamp(x: int, low: int, high: int) -> int:
    return max(low, min(x, high))


def around(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges at either end of ids(symbol_id)."""
    i = ids.select("symbol_id").distinct()
    out = edges.join(i, edges.src == i.symbol_id, "left_semi")
    return out.unionByName(edges.join(i, edges.dst == i.symbol_id, "left_semi").join(i, F.col("src") == i.symbol_id, "left_anti"))


def impact(catalog: Catalog, ids: DataFrame) -> DataFrame:
    """Degrees, risk, reasons and capped neighbour lists of ids(symbol_id), with kind and file path where known."""
    near = around(catalog.edges, ids)
    i = ids.select("symbol_id").distinct()
    blast = graph.risk_reasons(graph.blast_radius(near).join(i, "symbol_id", "left_semi"))
    counts = {x: f"total_{x}" for x in ("upstream", "downstream", "used_by", "uses")}
    blast = blast.withColumnsRenamed(counts | {"total": "total_connections"})
    meta = catalog.symbols.join(i, "symbol_id", "left_semi").groupBy("symbol_id").agg(F.min("kind").alias("kind"), F.min("file_path").alias("file_path"))
    return blast.join(graph.neighbours(near).join(i, "symbol_id", "left_semi"), "symbol_id").join(meta, "symbol_id", "left")


def one(catalog: Catalog, symbol_ids: list[str]) -> DataFrame:
    return catalog.edges.sparkSession.createDataFrame([(s,) for s in symbol_ids], "symbol_id string")


@tool
def search_symbols(catalog: Catalog, query: str, limit: int = 20) -> DataFrame:
    return retrieve.search_symbols(catalog.symbols, query, clamp(limit, 1, 50))


@tool
def search_symbols_enhanced(catalog: Catalog, query: str, limit: int = 20, search_files: bool = True, fuzzy: bool = True) -> DataFrame:
    kinds = ["symbol", *(["fuzzy_name"] if fuzzy else []), *(["file_path"] if search_files else [])]
    return retrieve.search_enhanced(catalog.symbols, query, clamp(limit, 1, 50), kinds)


@tool
def get_blast_radius(catalog: Catalog, symbol_id: str, usage_modes_filter: list[str] | None = None) -> DataFrame:
    """One row; the lists of type users and used types are cut to the cap first, then to those of a requested mode."""
    near = catalog.edges.where((F.col("src") == symbol_id) | (F.col("dst") == symbol_id))
    out = impact(Catalog(catalog.symbols, catalog.chunks, near, catalog.votes), one(catalog, [symbol_id]))
    if usage_modes_filter is None:
        return out
    fit = graph.with_modes(near.where("relation = 'uses'"), usage_modes_filter)
    sides = fit.agg(F.array_sort(F.collect_set(F.when(F.col("dst") == symbol_id, F.col("src")))).alias("in_"), F.array_sort(F.collect_set(F.when(F.col("src") == symbol_id, F.col("dst")))).alias("out_"))
    cut = lambda kept, side: F.array_join(F.array_intersect(F.split(kept, ","), side), ",").alias(kept)
    rest = [c for c in out.columns if c not in ("used_by", "uses")]
    return out.join(F.broadcast(sides)).select(*rest, cut("used_by", F.col("in_")), cut("uses", F.col("out_")))


@tool
def get_blast_radius_detailed(catalog: Catalog, symbol_id: str) -> DataFrame:
    near = catalog.edges.where((F.col("src") == symbol_id) | (F.col("dst") == symbol_id))
    return graph.edge_confidence(near).where(F.col("symbol_id") == symbol_id)


@tool
def batch_blast_radius(catalog: Catalog, symbol_ids: list[str]) -> DataFrame:
    return impact(catalog, one(catalog, symbol_ids))


@tool
def combined_impact(catalog: Catalog, symbol_ids: list[str]) -> DataFrame:
    """One row: distinct neighbours of all the symbols, the symbols left out, in each direction, and the risk of the whole."""
    ids = one(catalog, symbol_ids).distinct()
    way = lambda call, use: F.when(F.col("relation") == "calls", call).otherwise(use)
    e = around(catalog.edges, ids)
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other"), way("callees", "types_used").alias("way")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other"), way("callers", "type_users").alias("way")))).alias("x")).select("x.*")
    far = ends.join(ids, ends.id == ids.symbol_id, "left_semi").join(ids, F.col("other") == ids.symbol_id, "left_anti").select("way", "other").distinct()
    n = far.agg(*(F.count_if(F.col("way") == w).alias(w) for w in ("callers", "callees", "type_users", "types_used")))
    return n.withColumn("risk", graph.risk(F.col("callers") + F.col("callees") + F.col("type_users") + F.col("types_used"), F.col("callers") + F.col("type_users")))


@tool
def get_symbol_content(catalog: Catalog, symbol_id: str) -> DataFrame:
    c = catalog.chunks.where(F.col("symbol_id") == symbol_id)
    return c.select("symbol_id", "file_path", F.substring("content", 1, 8000).alias("content"), (F.length("content") > 8000).alias("truncated"))


@tool
def semantic_search(catalog: Catalog, query: str, limit: int = 10) -> DataFrame:
    """The chunks nearest the query and its up to five expansion terms by hashed embeddings, twice the limit of them
    raised by the symbols' boosts and cut to the limit; symbols by name with score 0 where there are no chunks."""
    limit = clamp(limit, 1, 25)
    weights = fb.expansion_weights(catalog.votes.where(F.col("query_text") == query))
    terms = fb.expanded_queries(weights).first()
    text = query if terms is None else f"{query} {terms.terms}"
    score = retrieve.cosine(retrieve.hash_embedding(F.col("content")), retrieve.hash_embedding(F.lit(text)))
    near = catalog.chunks.select("symbol_id", "file_path", F.round(score, 9).alias("score"), F.substring("content", 1, 300).alias("preview")).orderBy(F.desc("score"), "symbol_id").limit(2 * limit)
    # The few rows found decide which votes are read further.
    boosts = fb.boost_weights(catalog.votes.join(F.broadcast(near.select("symbol_id").distinct()), "symbol_id", "left_semi")).select("symbol_id", "boost")
    j = near.join(boosts, "symbol_id", "left").withColumn("boost", F.coalesce("boost", F.lit(0.0)))
    found = j.select("symbol_id", "file_path", F.round(F.col("score") + ALPHA * F.col("boost"), 4).alias("score"), F.round("score", 4).alias("original_score"), F.round("boost", 4).alias("boost"), "preview").orderBy(F.desc("score"), "symbol_id").limit(limit)
    if not found.isEmpty():
        return found
    zero = F.lit(0.0)
    return search_symbols(catalog, query, limit).select("symbol_id", "file_path", zero.alias("score"), zero.alias("original_score"), zero.alias("boost"), F.lit("").alias("preview"))


@tool
def analyze_pr_diff(catalog: Catalog, diff_text: str, max_symbols: int = 10) -> DataFrame:
    """Changed symbols of a unified diff that the index knows, with the impact of the first max_symbols of them."""
    diffs = catalog.edges.sparkSession.createDataFrame([(0, diff_text)], "diff_id int, text string")
    hits = diff.resolve(diff.changed_symbols(diff.diff_lines(diffs)), catalog.symbols.select("symbol_id").distinct()).where("symbol_id is not null")
    first = hits.orderBy("symbol_id", "name").limit(max_symbols).select("symbol_id", "name", "status", "symbol_type", "change_type")
    blast = impact(catalog, first).select("symbol_id", "risk", "reasons", "total_connections", "total_upstream", "total_downstream", "file_path")
    return first.join(blast, "symbol_id").withColumn("high_risk", F.col("risk").isin("high", "critical"))


@tool
def find_dependency_path(catalog: Catalog, from_symbol: str, to_symbol: str, max_depth: int = 5) -> DataFrame:
    """(path, edge_types, length): over calls if they connect the two, else over calls and type uses that avoid global state."""
    depth = clamp(max_depth, 1, 10)
    found = graph.dependency_path(catalog.edges.where("relation = 'calls'"), from_symbol, to_symbol, depth)
    return found if not found.isEmpty() else graph.dependency_path(catalog.edges, from_symbol, to_symbol, depth, graph.GLOBAL_STATE)


@tool
def traverse_graph(catalog: Catalog, symbol_id: str, depth: int = 1, summary_only: bool = False) -> DataFrame:
    """Symbols within depth - 1 steps with their hop and neighbours: counts for summary_only, else the capped lists of the
    nearest 50 symbols."""
    seen = graph.reach(catalog.edges, one(catalog, [symbol_id]), clamp(depth, 1, 5) - 1, None if summary_only else graph.CAP)
    near = around(catalog.edges, seen)
    return seen.join(graph.degrees(near) if summary_only else graph.neighbours(near), "symbol_id")


@tool
def get_graph_stats(catalog: Catalog) -> DataFrame:
    deg = graph.degrees(catalog.edges)
    return deg.agg(F.count("*").alias("nodes"), F.coalesce(F.sum(F.col("downstream") + F.col("uses")), F.lit(0)).alias("edges"))


@tool
def get_index_meta(catalog: Catalog) -> DataFrame:
    return catalog.chunks.agg(F.count("*").alias("chunks"), F.countDistinct("symbol_id").alias("symbols"), F.countDistinct("file_path").alias("files"))


@tool
def get_symbols_in_file(catalog: Catalog, file_path: str) -> DataFrame:
    found = retrieve.path_matches(catalog.symbols, file_path)
    return found.orderBy(*(["start_line"] if "start_line" in found.columns else []), "symbol_id")


@tool
def submit_search_feedback(catalog: Catalog, query_text: str, symbol_id: str = "", feedback: int = 0, original_score: float = 0.0, reason: str = "") -> DataFrame:
    """The row to append to the votes; without a symbol or a vote it is a vote against the query as a whole."""
    if feedback not in (-1, 0, 1):
        raise ValueError("feedback must be 1, -1 or 0")
    if symbol_id and feedback:
        row = (symbol_id, query_text, feedback, original_score, reason or None)
    else:
        row = (f"_query_level:{query_text[:QUERY_KEY]}", query_text, -1, 0.0, f"Query-level negative feedback{f': {reason}' if reason else ' (no specific symbol)'}")
    return catalog.votes.sparkSession.createDataFrame([row], "symbol_id string, query_text string, vote int, original_score double, reason string")


@tool
def submit_ai_feedback(catalog: Catalog, client_id: str = "", pr_context: str = "", tools_called: list[str] | None = None, results_used: list[dict] | None = None, results_expected: str = "", quality_rating: int = 0, improvement_suggestions: str = "") -> DataFrame:
    """The pending row to append to the feedback; a rating outside 1 to 5 is null."""
    used = [(r.get("symbol_id"), r.get("file_path"), r.get("helpful"), r.get("notes")) for r in results_used or []]
    row = (client_id or None, pr_context or None, tools_called or [], used, results_expected or None, quality_rating if 1 <= quality_rating <= 5 else None, improvement_suggestions or None, "pending")
    schema = "client_id string, pr_context string, tools_called array<string>, results_used array<struct<symbol_id:string,file_path:string,helpful:boolean,notes:string>>, results_expected string, quality_rating int, improvement_suggestions string, status string"
    return catalog.votes.sparkSession.createDataFrame([row], schema)


@tool
def get_reinforcement_stats(catalog: Catalog) -> DataFrame:
    return fb.reinforcement_stats(fb.boost_weights(catalog.votes), fb.expansion_weights(catalog.votes))
