"""The gate's queries against their SQL on null texts, null marks and texts that end or begin in blanks of all kinds."""

import duckdb
import pytest

from lodestrata import registry
from lodestrata.operators import feedback
from lodestrata.sources import views

BLANKS = [" ", "\t", "\n", "\x0b", "\r\n", "\x85", *map(chr, (0xA0, 0x180E, 0x2003, 0x200B, 0x2028, 0x3000)), " \n ", chr(0xA0) + " "]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """A folder of documents and labels, and a connection that sees them."""
    d, con = tmp_path_factory.mktemp("odd"), duckdb.connect()
    texts = [None, "", *(b * n + "x" * k + b * m for b in BLANKS for k in (0, 5, 9, 10, 11, 19, 20, 21, 29, 30, 31, 60, 300) for n, m in ((0, 1), (1, 0), (0, 15), (15, 15)))]
    texts = [t for t in texts for _ in range(3)]
    # Every residue of the ids that the view takes meets every text in the end: 504 is a multiple of 4, 6, 7, 8 and 9.
    rows = [(i * 11, t) for i, t in enumerate(texts * 2)]
    con.execute("CREATE TABLE d (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO d VALUES (?, ?)", rows)
    con.execute(f"COPY (SELECT *, 'en' AS lang, 's' AS source, length(text) AS n_chars FROM d) TO '{d}/documents.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT doc_id, (CASE doc_id % 5 WHEN 0 THEN NULL ELSE doc_id % 2 END)::INT AS quality, (CASE doc_id % 13 WHEN 0 THEN NULL ELSE (doc_id % 3 = 0)::INT END)::INT AS toxic FROM d) TO '{d}/labels.parquet' (FORMAT parquet)")
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return str(d), con


def differ(spark, odd, name):
    d, con = odd
    df = registry.QUERIES[name](spark, d)
    columns = sorted(df.columns)
    got, want = map(tuple, df.select(*columns).collect()), con.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})").fetchall()
    return set(got) ^ set(want)


@pytest.mark.parametrize("name", ["quality_gate", "accepted_feedback", "evaluated_feedback", "unconsumed_feedback", "feedback_round_votes", "feedback_round_state", "feedback_round_due"])
def test_null_and_blank_texts(spark, odd, name):
    assert not differ(spark, odd, name)


def test_stats_round_as_sql_does(spark, odd):
    """Null and blank texts, and means that lie half way between two roundings by name only: 402 / 400 = 1.005."""
    assert not differ(spark, odd, "feedback_stats")
    rows = [("accepted", 0.5 + i % 2 / 8, 1 + (i < 2)) for i in range(400)] + [("rejected", 0.5, 1 + (i < 29)) for i in range(200)]
    got = feedback.feedback_stats(spark.createDataFrame(rows, "status string, score double, rating int")).collect()
    con = odd[1]
    con.execute("CREATE OR REPLACE TABLE gate (status VARCHAR, score DOUBLE, rating INT)")
    con.executemany("INSERT INTO gate VALUES (?, ?, ?)", rows)
    want = con.sql("SELECT status, count(*) AS n, round(avg(score), 4), round(avg(rating), 2) FROM gate GROUP BY status").fetchall()
    con.execute("DROP TABLE gate")
    assert sorted(map(tuple, got)) == sorted(want) and ("accepted", 400, 0.5625, 1.0) in want


def test_signals_round_as_sql_does(spark, odd):
    """Null and blank texts, and a mean half way between two roundings by name only: 2.05 / 32 = 0.0640625."""
    assert not differ(spark, odd, "symbol_signals")
    rows = [("k", "accepted", 1.0, 5, None), ("k", "accepted", 0.75, 5, True), *[("k", "accepted", 0.75, 3, None)] * 30]
    got = feedback.symbol_signals(spark.createDataFrame(rows, "symbol_id string, status string, score double, rating int, helpful boolean").coalesce(1)).collect()
    assert [tuple(r) for r in got] == duckdb.sql("SELECT 'k', round(2.05::DOUBLE / 32, 6), 32").fetchall() == [("k", 0.064062, 32)]


def test_whole_texts_are_not_joined(spark, odd):
    plan = views.ai_feedback(spark, odd[0])._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join Inner, (doc_id", 1)
    assert "substring(text" in below and "substring(text" not in above
