"""Tools over a small catalog."""

import pytest

from lodestrata.tools import TOOLS, Catalog, call


@pytest.fixture(scope="module")
def catalog(spark):
    symbols = spark.createDataFrame([(f"m::{x}", x, f"src/{x}.rs", "fn") for x in "abcde"], "symbol_id string, short_name string, file_path string, kind string")
    chunks = spark.createDataFrame([(f"m::{x}", f"src/{x}.rs", f"fn {x}() " + x * 9000) for x in "abc"], "symbol_id string, file_path string, content string")
    edges = [("m::a", "m::b", "calls", []), ("m::b", "m::c", "calls", []), ("m::d", "m::a", "uses", ["construction"]), ("m::e", "m::a", "uses", []), ("m::c", "m::c", "calls", [])]
    votes = [("m::c", "find", 1)] * 40 + [("m::a", "find", -1)]
    return Catalog(symbols, chunks, spark.createDataFrame(edges, "src string, dst string, relation string, usage_modes array<string>"), spark.createDataFrame(votes, "symbol_id string, query_text string, vote int"))


def test_names(catalog):
    assert {"search_symbols", "search_symbols_enhanced", "get_blast_radius", "get_blast_radius_detailed", "batch_blast_radius", "get_symbol_content", "semantic_search", "analyze_pr_diff", "find_dependency_path", "traverse_graph", "get_graph_stats", "get_index_meta", "get_symbols_in_file", "submit_search_feedback", "submit_ai_feedback", "get_reinforcement_stats"} <= set(TOOLS)
    with pytest.raises(KeyError):
        call(catalog, "absent")


def test_blast_radius(catalog):
    r = call(catalog, "get_blast_radius", symbol_id="m::a").first()
    assert (r.total_connections, r.total_used_by, r.used_by, r.downstream, r.file_path, r.risk) == (3, 2, "m::d,m::e", "m::b", "src/a.rs", "low")
    assert call(catalog, "get_blast_radius", symbol_id="m::a", usage_modes_filter=["reference"]).first().used_by == "m::e"
    assert call(catalog, "get_blast_radius", symbol_id="absent").isEmpty()
    assert call(catalog, "get_blast_radius_detailed", symbol_id="m::a").first().overall == "medium"


def test_self_edge_counts_at_both_ends_once(catalog):
    r = call(catalog, "batch_blast_radius", symbol_ids=["m::c", "m::c"]).first()
    assert (r.total_upstream, r.total_downstream) == (2, 1)


def test_combined_impact(catalog):
    r = call(catalog, "combined_impact", symbol_ids=["m::a", "m::b"]).first()
    assert (r.callers, r.callees, r.type_users, r.types_used, r.risk) == (0, 1, 2, 0, "low")


def test_paths_and_hops(catalog):
    assert tuple(call(catalog, "find_dependency_path", from_symbol="m::a", to_symbol="m::c").first()) == ("m::a>m::b>m::c", "CALLS>CALLS", 2)
    assert call(catalog, "find_dependency_path", from_symbol="m::c", to_symbol="m::d").first().length == 3
    rows = call(catalog, "traverse_graph", symbol_id="m::a", depth=9, summary_only=True).collect()
    assert {r.symbol_id: r.hop for r in rows} == {"m::a": 0, "m::b": 1, "m::d": 1, "m::e": 1, "m::c": 2}
    assert [r.symbol_id for r in call(catalog, "traverse_graph", symbol_id="m::a").collect()] == ["m::a"]


def test_search(catalog):
    assert [r.symbol_id for r in call(catalog, "search_symbols", query="M::", limit=2).collect()] == ["m::a", "m::b"]
    assert call(catalog, "search_symbols_enhanced", query="src/d.rs", fuzzy=False).first().match_type == "file_path"
    assert call(catalog, "search_symbols_enhanced", query="src/d", fuzzy=False, search_files=False).isEmpty()
    found = call(catalog, "semantic_search", query="find").collect()
    assert {r.symbol_id: r.boost for r in found} == {"m::a": 0.0, "m::b": 0.0, "m::c": round(40 / 45 * 2 - 1, 4)}
    empty = Catalog(catalog.symbols, catalog.chunks.limit(0), catalog.edges, catalog.votes)
    assert call(empty, "semantic_search", query="::e").first().symbol_id == "m::e"


def test_content_and_feedback(catalog):
    r = call(catalog, "get_symbol_content", symbol_id="m::a").first()
    assert len(r.content) == 8000 and r.truncated
    assert call(catalog, "submit_search_feedback", query_text="q" * 90).first().symbol_id == "_query_level:" + "q" * 80
    assert call(catalog, "submit_search_feedback", query_text="q", symbol_id="m::a", feedback=1).first().vote == 1
    with pytest.raises(ValueError):
        call(catalog, "submit_search_feedback", query_text="q", feedback=2)
    assert call(catalog, "submit_ai_feedback", quality_rating=9, results_used=[{"symbol_id": "m::a"}]).first().quality_rating is None


def test_views(spark, catalog):
    catalog.as_views()
    assert spark.sql("SELECT count(*) FROM edges").first()[0] == 5
