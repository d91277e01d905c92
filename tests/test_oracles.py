"""Every query that has SQL agrees with DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from tarnflow import catalog

FOLDER = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, bool):
        return v
    if hasattr(v, "as_tuple"):
        return float(v)
    return [plain(x) for x in v] if isinstance(v, list) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_agrees_with_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    got, expected = rows_of(df.columns, df.collect()), rows_of(want.columns, want.fetchall())
    assert len(got) == len(expected) and expected
    wrong = [(g, e) for g, e in zip(got, expected, strict=True) if g != e]
    assert not wrong, (len(wrong), len(got), wrong[:3])
