"""join_groups against a plain left join: large, small, missing and null groups, repeated rows, no rows."""

import pytest

from lodestrata.llm.common import join_groups

ROWS = [(i, "large") for i in range(40)] + [(40, "small"), (41, "small2"), (41, "small2"), (42, "absent"), (43, None)]


@pytest.mark.parametrize("rows", [ROWS, []])
@pytest.mark.parametrize("total", [len(ROWS), 10_000, 10_000_000])
def test_same_as_left_join(spark, rows, total):
    left = spark.createDataFrame(rows, "id long, key string")
    groups = spark.createDataFrame([("large", 40, 1.0), ("small", 1, 2.0), ("small2", 2, 3.0)], "key string, n long, plan double")
    found = [tuple(r) for r in join_groups(left, groups, ["key"], "n", total).select("id", "key", "n", "plan").collect()]
    plain = [tuple(r) for r in left.join(groups, "key", "left").select("id", "key", "n", "plan").collect()]
    assert sorted(found, key=str) == sorted(plain, key=str)
