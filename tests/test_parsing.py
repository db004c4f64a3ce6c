from lodestrata.functions import diff, rust
from lodestrata.operators import snapshots
from lodestrata.plans.samples import DIFFS, FILES
from lodestrata.streaming import jobs
from pyspark.sql import functions as F


def chunks(spark, files, **options):
    return rust.chunk_files(spark.createDataFrame(files, "path string, source string"), **options).collect()


def test_symbol_ids_and_lines(spark):
    rows = sorted(chunks(spark, FILES[:1], summaries=False), key=lambda r: r.start_line)
    assert [(r.symbol_id, r.kind) for r in rows] == [("auth::save_session", "fn"), ("auth::login_user", "fn"), ("auth::Account", "struct"), ("auth::Account", "impl"), ("auth::renew", "fn")]
    assert rows[0].content.startswith("// Saves a session.\n// Imports: crate::store::Session, std::fmt\n\n")
    assert "auth::Account::renew" in {r.symbol_id for r in chunks(spark, FILES[:1], summaries=False, impl_methods=True)}


def test_small_files(spark):
    assert chunks(spark, [("a.rs", "")]) == [] and chunks(spark, [("a.rs", "pub mod x;\n")]) == []
    assert [r.kind for r in chunks(spark, FILES[4:5], summaries=False)] == ["module"]


def test_summaries(spark):
    rows = {r.symbol_id: r for r in chunks(spark, FILES)}
    assert rows["auth::file_summary"].content.splitlines()[:4] == ["// File: src/auth.rs", "// Module: src::auth", "// Symbols defined: 5", "// Imports: crate::store::Session, std::fmt"]
    assert "  pub struct Account  // line" in rows["auth::file_summary"].content and "  // pub fn login_user(name: &str) -> bool" in rows["auth::file_summary"].content
    assert "// Sub-modules: rows, cache" in rows["store::mod::module_exports"].content and "store::rows::module_exports" not in rows


def test_small_helpers(spark):
    r = spark.createDataFrame([("use a::b::C;\nuse a::D as E;\nuse x::{F, g::H as I};\nuse z::*;\n", "src/api/auth/x.rs", " a \n b ")], "s string, p string, t string").select(rust.import_map(F.col("s")).alias("m"), rust.domain(F.col("p")).alias("d"), rust.one_line(F.col("t")).alias("t")).first()
    assert r.m == {"C": "a::b::C", "E": "a::D", "F": "x::F", "I": "x::g::H"} and r.d == "http" and r.t == "a b"


def test_edges(spark):
    chunks = rust.chunk_files(spark.createDataFrame(FILES, "path string, source string"), summaries=False)
    calls = {(r.src, r.dst) for r in rust.call_edges(chunks).collect()}
    assert ("auth::login_user", "auth::save_session") in calls and ("auth::renew", "auth::save_session") in calls
    assert ("store::rows::append", "store::rows::flush_all") in calls


def test_usage_modes(spark):
    cases = [("match x { Foo::A => 1 }", "Foo", ["pattern_match"]), ("let a = Foo::new(1)", "Foo", ["construction"]), ("  pub a: Option<Foo>,", "Foo", ["field_declaration", "type_param"]), ("impl Foo for Bar {", "Foo", ["trait_impl"]), ("use a::Foo;", "Foo", ["import"]), ("a Foo b", "Foo", ["type_reference"]), ("none", "Foo", ["reference"]), ("String", "String", ["reference"])]
    got = spark.createDataFrame(cases, "c string, n string, e array<string>").select(rust.usage_modes(F.col("c"), F.col("n")).alias("m"), "e").collect()
    assert all(r.m == r.e for r in got)


def test_diffs(spark):
    lines = diff.diff_lines(spark.createDataFrame(DIFFS, "diff_id int, text string"))
    got = {(r.diff_id, r.name): (r.status, r.change_type) for r in diff.changed_symbols(lines).collect()}
    assert got == {(1, "login_user"): ("modified", "signature_change"), (2, "logout_user"): ("added", "new"), (2, "flush_all"): ("deleted", "deleted"), (4, "Account"): ("modified", "struct_field"), (5, "put"): ("added", "trait_impl")}


def test_names_are_found_without_comparing_each_with_each_id(spark):
    """resolve gives what comparing all pairs gives, for odd names too, and doesn't compare them."""
    ids = ["a::b::Foo", "a::FOO::foo", "x::fo", "fo", "", "a.c::İx", "f", *(f"p{i % 7}::f{i}" for i in range(60))]
    changes = [(d, n, s) for d, n in enumerate(["foo", "FO", "f", "", "::", "f1", "f12", "a.c", "zzz", "p1::f1", "i̇", None]) for s in ("modified", "deleted")] + [(99, "foo", "added")]
    got = diff.resolve(spark.createDataFrame(changes, "diff_id int, name string, status string"), spark.createDataFrame([(x,) for x in ids], "symbol_id string"))
    want = []
    for d, n, s in changes:
        hits = sorted((x for x in ids if n is not None and n.lower() in x.lower()), key=str.encode)[: 3 if s == "deleted" else 5]
        want += [(d, n, s, x) for x in hits or ([None] if s != "deleted" else [])]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got.select("diff_id", "name", "status", "symbol_id").collect()), key=key) == sorted(want, key=key)
    assert "Contains(" not in got._jdf.queryExecution().toString()


def test_item_lines(spark):
    files = [*FILES, ("src/late.rs", "\n\n\nfn a() {}\n\n\nfn b() {}")]
    for r in rust.items(spark.createDataFrame(files, "path string, source string")).where("kind is not null").collect():
        source = dict(files)[r.path]
        start = source.index(r.body)
        assert (r.start_line, r.end_line) == (source.count("\n", 0, start) + 1, source.count("\n", 0, start + len(r.body)) + 1)


def test_snapshots(spark, tmp_path):
    store = snapshots.SnapshotStore(spark, f"file://{tmp_path}")
    store.replace(chunks=spark.range(3).toDF("id"))
    store.replace(chunks=spark.range(5).toDF("id"))
    assert store.load("chunks").count() == 5
    store.rollback()
    assert store.load("chunks").count() == 3


def test_machine_and_limiter():
    assert jobs.accept(None, [(1, 1, "CREATED"), (2, 2, "RESOLVED"), (3, 3, "INGESTING"), (4, 4, "FAILED"), (5, 5, "CREATED")])[1] == [(1, "CREATED", True), (2, "RESOLVED", False), (3, "INGESTING", True), (4, "FAILED", True), (5, "CREATED", False)]
    m = 1_000_000
    assert [ok for _, ok in jobs.limit_rate([], [(0, 1), (m, 2), (2 * m, 3), (60 * m, 4), (61 * m, 5)], 2, 60)[1]] == [True, True, False, False, True]


def test_streams_equal_batch(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    stream = jobs.windowed(jobs.event_stream(spark, d), late="0 seconds").select("event_type", "n")
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == 1000
