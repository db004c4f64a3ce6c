"""Every query with a SQL twin gives DuckDB's rows on the smallest tables; the others have rows."""

import duckdb
import pytest

from lodestrata import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def normal(rows):
    return sorted(tuple(repr(round(x, 6) + 0.0) if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    if name not in registry.ORACLES:
        assert rows
        return
    sql = registry.ORACLES[name]
    found = con.sql(sql)
    assert sorted(found.columns) == columns
    assert normal(rows) == normal(con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())
