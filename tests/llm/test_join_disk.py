"""The join of op1 on disk: shuffle files go with the write that made them, shingles are shuffled once, clusters lose no link."""

import os
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import jaccard_join
from lodestrata.llm.common import SHUFFLE_CLEANUP, staged


def test_a_stage_leaves_no_shuffle_files(spark):
    """Before, they stayed until the driver collected its garbage, so those of several steps were on disk at once."""
    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for d in dirs for _, _, own in os.walk(d) for f in own if f.startswith("shuffle_")}
    before, setting = files(), spark.conf.get(SHUFFLE_CLEANUP, None)
    out = staged(spark.range(10_000).repartition(4, "id").groupBy((F.col("id") % 1000).alias("k")).count())
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left
    assert out.count() == 1000 and spark.conf.get(SHUFFLE_CLEANUP, None) == setting


@pytest.mark.parametrize("slots", [32768, 1 << 20])
def test_levels_are_never_too_low(spark, slots):
    """In a filter with many shingles a slot and in one with few: the level of the df or a higher one, 0 only for unshared ones."""
    rng = np.random.default_rng(4)
    df = {int(g): int(d) for g, d in zip(rng.integers(0, 1 << 48, 20_000), rng.choice([2, 3, 4, 5, 16, 17, 256, 257, 9999], 20_000))}
    alone = [int(g) for g in rng.integers(0, 1 << 48, 1000)]
    rows = spark.createDataFrame([(g,) for g in [*df, *alone]], "gram long")
    got = {r.gram: r.level for r in jaccard_join.with_level(rows, spark.createDataFrame(list(df.items()), "gram long, df long"), slots).collect()}
    low = {g: sum(d >= least for least in jaccard_join.LEVELS) for g, d in df.items()}
    assert all(len(jaccard_join.LEVELS) >= got[g] >= low[g] > 0 for g in df)
    if slots > 32768:
        assert sum(got[g] == low[g] for g in df) > 0.95 * len(df) and sum(got[g] == 0 for g in alone) > 950


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_linked_sets_share_a_rarest_shingle(rows):
    """Over batches of any length: exactly the shingles that a plain version posts, and one in common for every linked pair."""
    rng, percent = np.random.default_rng(5), 85
    base = rng.integers(0, 1 << 48, 60)
    sets = [np.unique(np.where(rng.random(60) < rng.choice([0.02, 0.05, 0.5]), rng.integers(0, 1 << 48, 60), base))[: rng.integers(1, 61)] for _ in range(60)]
    level = lambda g: int(g) % 4 if g not in base else int(g) % 3 + 1
    flat = [(i, len(s), int(g), level(g)) for i, s in enumerate(sets) for g in s]
    cut = [pa.record_batch([pa.array(c) for c in zip(*flat[k : k + rows])], ["id", "n", "gram", "level"]) for k in range(0, len(flat), rows)]
    got = {i: set() for i in range(60)}
    for batch in jaccard_join.rarest(iter(cut), percent):
        for r in batch.to_pylist():
            got[r["id"]].add(r["gram"])
    for i, s in enumerate(sets):
        own = sorted((level(g), int(g)) for g in s if level(g))
        assert got[i] == {g for _, g in own[: max(0, len(own) - jaccard_join.least_overlap(len(s), percent) + 1)]}
    pairs = [(i, j) for i in range(60) for j in range(i) if 100 * (k := len(a := np.intersect1d(sets[i], sets[j]))) >= percent * (len(sets[i]) + len(sets[j]) - k) and all(map(level, a))]
    assert len(pairs) > 5 and all(got[i] & got[j] for i, j in pairs)
