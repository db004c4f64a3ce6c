"""connected() on long chains with shuffled ids, stars, self-loops, repeated edges and no edges."""

import random

import pytest

from lodestrata.llm.common import connected


def labels(spark, edges, **bounds):
    return {r.node: r.label for r in connected(spark.createDataFrame(edges, "a long, b long"), **bounds).collect()}


def test_shuffled_chain(spark):
    ids = list(range(1000))
    random.Random(1).shuffle(ids)
    edges = list(zip(ids, ids[1:])) + [(2000 + i, 2500) for i in range(20)] + [(3, 3), (4000, 4000), (2000, 2500)]
    assert labels(spark, edges) == {i: 0 for i in ids} | {i: 2000 for i in [*range(2000, 2020), 2500]}
    assert labels(spark, []) == {}


def test_an_unfinished_result_is_an_error(spark):
    with pytest.raises(RuntimeError):
        labels(spark, [(5, 1), (5, 2), (5, 3)], rounds=1)
