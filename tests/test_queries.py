"""Every query with SQL gives the rows of that SQL, on the smallest driver tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from vellumflow import queries as core

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v != v:
        return None
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(D):
        pytest.skip("the driver's tables are not here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_same_rows(spark, duck, name):
    df = core.QUERIES[name](spark, D)
    want = duck.execute(core.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    rows = sorted(repr(tuple(map(plain, r))) for r in want.fetchall())
    assert sorted(repr(tuple(map(plain, r))) for r in df.select(*columns).collect()) == rows


def test_every_query_has_sql():
    assert set(core.QUERIES) == set(core.SQL)


def test_entry(spark, duck):
    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())
