"""The queries with SQL agree with DuckDB, row by row."""

import duckdb
import pytest

from tarnflow.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df, want = QUERIES[name](spark, FOLDER), con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    got = sorted(tuple(r[c] for c in order) for r in df.collect())
    place = [want.columns.index(c) for c in order]
    assert got == sorted(tuple(r[i] for i in place) for r in want.fetchall())
