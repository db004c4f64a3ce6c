"""with_decision against a plain join, where slots hold one or several decisions; the columns of a shard row by value."""

import zlib

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import common, sharding


@pytest.mark.parametrize("slots", [4, 32768])
def test_same_as_a_join(spark, monkeypatch, slots):
    monkeypatch.setattr(common, "slot_of", lambda h, _: F.pmod(h, F.lit(slots)))
    keys = [*range(50), None, 7, 7]
    rows = spark.createDataFrame([(k, f"t{i}", "x", 1) for i, k in enumerate(keys)], "doc_id long, slot string, bits string, mixed int")
    value = {k: 0 if k is None else k % 3 for k in keys}
    decided = spark.createDataFrame(list(value.items()), "doc_id long, value int")
    got = common.with_decision(rows, decided, len(keys))
    assert got.columns == [*rows.columns, "decided"]
    assert sorted((r.slot, r.decided) for r in got.collect()) == sorted((f"t{i}", value[k]) for i, k in enumerate(keys))
    assert common.with_decision(rows.limit(0), decided.limit(0), 0).count() == 0


def test_shard_rows_by_value(spark):
    texts = [(1, "abc"), (2, None), (3, ""), (4, "é漢\U0001f600"), (4, "é漢\U0001f600"), (None, "abc")]
    got = sharding.shard(spark.createDataFrame(texts, "doc_id long, text string"), 3).collect()
    want = sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == want
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)} and all(0 <= r.shard < 3 for r in got)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
