"""Logs, the index store and its jobs, and the stateful streams against their batch twins."""

import pytest
from pyspark.sql import functions as F

from lodestrata import schemas
from lodestrata.functions import replies
from lodestrata.operators import feedback, index, logs, snapshots
from lodestrata.sources import views
from lodestrata.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_incidents(spark, tmp_path):
    store = logs.Incidents(spark, f"file://{tmp_path}/incidents")
    with pytest.raises(ValueError):
        store.create({"raw_log": "  "})
    a = store.create({"raw_log": "boom", "fingerprint": "f1", "environment": "prod"})
    assert store.get(a).state == "CREATED" and store.get(a).events == 1
    with pytest.raises(logs.InvalidTransition):
        store.transition(a, "RESOLVED")
    store.note(a, "chat_message", {"text": "hi"})
    assert store.get(a).state == "CREATED" and store.get(a).events == 2
    store.analyse(a, {"root_cause": "c", "patch": "p"})
    assert store.get(a).state == "VALIDATING"
    with pytest.raises(logs.InvalidTransition):
        store.analyse(a, {})
    store.transition(a, "RESOLVED")
    resolved, cases, counts = logs.resolution_effects(store.log.read())
    assert resolved.first()[:3] == ("f1", "c", "p") and cases.first().tags == ["auto-generated", "RESOLVED"] and cases.first().environment == "prod" and counts.first().resolved == 1
    with pytest.raises(LookupError):
        store.get("absent")
    store.log.reset()
    assert store.list().count() == 0


def test_store(spark, tmp_path):
    store = snapshots.SnapshotStore(spark, f"file://{tmp_path}/store")
    with pytest.raises(LookupError):
        store.load("edges")
    edge = lambda *rows: spark.createDataFrame(rows, schemas.EDGES)
    store.replace({"commit": "1"}, edges=edge(("a", "b", "calls", []), ("a", "b", "calls", ["x"])))
    assert store.load("edges").count() == 1 and store.header()["meta"] == {"commit": "1"}
    other = snapshots.SnapshotStore(spark, store.root)
    stale = other.header()
    store.replace(edges=edge(("a", "c", "uses", [])))
    with pytest.raises(Exception, match="already exists|AlreadyExists"):
        other._point(stale, ["x"], {})
    store.note(commit="2")
    assert store.header()["meta"] == {"commit": "2"} and store.load("edges").first().dst == "c"
    store.rollback()
    assert store.load("edges").first().dst == "b" and len(store.vacuum()) == 1
    store.reset()
    assert store.header()["history"] == []


def test_roots_and_changes(spark):
    assert index.allowed_root("/a/b/c", ["/a/b"]) and index.allowed_root("/a/b", ["/a/b"])
    assert not any(index.allowed_root(x, ["/a/b", "/"]) for x in ("/", "/a", "/a/bc", "/a/b/../c"))
    got = {tuple(r) for r in index.git_changes(spark, "M\tsrc/a.rs\nD\tsrc/b.rs\nA\tx.md\nR100\tsrc/c.rs\tsrc/d.rs\n").collect()}
    assert got == {("src/a.rs", "changed"), ("src/b.rs", "deleted"), ("src/c.rs", "deleted"), ("src/d.rs", "changed")}


def test_embedding_job_takes_any_embedder(spark, tmp_path):
    files = spark.createDataFrame([("src/a.rs", "pub fn one(x: u64) -> u64 {\n    x\n}\n")], "path string, source string")
    store = snapshots.SnapshotStore(spark, f"file://{tmp_path}/index")
    first = index.rebuild(files, store)
    index.reembed(store, lambda text: F.array(F.length(text).cast("double")))
    assert all(len(r.embedding) == 1 for r in store.load("vectors").collect()) and store.load("chunks").count() == 2
    assert index.fuller(store) != first
    store.rollback()
    assert all(len(r.embedding) == 16 for r in store.load("vectors").collect())
    index.write_branch(store.load("vectors"), "feature/x", f"file://{tmp_path}/branches")
    index.write_branch(store.load("vectors"), "main", f"file://{tmp_path}/branches")
    assert {r.collection for r in spark.read.parquet(f"file://{tmp_path}/branches").select("collection").distinct().collect()} == {"CodeChunk_feature_x", "CodeChunk_main"}


def test_gate_takes_null_texts(spark):
    rows = [(1, 1, 2, 4, None, "x" * 300), (2, 0, 0, None, None, None)]
    got = feedback.quality_gate(spark.createDataFrame(rows, "feedback_id int, n_tools int, n_mentions int, rating int, suggestions string, expected string")).orderBy("feedback_id").collect()
    assert (got[0].points, got[0].status) == (60, "accepted") and "feedback too short" in got[1].reasons


def test_reply(spark):
    said = ['{"root_cause": "r", "patch": "p", "confidence": [{"value": "0.9"}]}', "no json"]
    got = [r.a for r in spark.createDataFrame([(x,) for x in said], "t string").select(replies.analysis(F.col("t")).alias("a")).collect()]
    assert got[0].confidence[0] == ("Unknown", "0.9") and got[1].patch.startswith("// TODO") and got[1].confidence[0] == ("LLM", "0.50")


@pytest.mark.parametrize("name", ["machine", "limiter"])
def test_streams_give_what_batch_gives(spark, tmp_path, name):
    rows = views.incident_events(spark, SF).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    first = jobs.event_stream(spark, SF)
    if name == "machine":
        named = views.STATES
        state = F.create_map(*(F.lit(x) for kv in named.items() for x in kv))[F.col("event_type")]
        stream = jobs.incident_machine(first.select(F.col("user_id").alias("session_id"), "event_id", state.alias("state"), "ts"))
        want = jobs.accepted(rows.select("session_id", "at", "event_id", "state"))
    else:
        stream = jobs.rate_limiter(first, 2)
        want = jobs.limited(rows.select(F.col("session_id").alias("key"), "at", "event_id"), 2, 60, "key")
    # A session or key goes on from the state that the batch before left, so files of one order give the batch's rows.
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"file://{tmp_path}").trigger(availableNow=True).start()
    q.awaitTermination()
    columns = sorted(stream.columns)
    assert sorted(map(tuple, spark.table(name).select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_feedback_tick(spark, tmp_path):
    got = []
    rows = jobs.event_stream(spark, SF).where("event_type = 'error'")
    q = jobs.feedback_tick(rows, lambda df, n: got.append(df.count()), f"file://{tmp_path}")
    q.awaitTermination()
    jobs.stop(q)
    assert sum(got) == spark.read.parquet(f"{SF}/events.parquet").where("event_type = 'error'").count()
