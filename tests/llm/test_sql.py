"""The registered queries that SQL can express, against it."""

import os

import duckdb
import pytest

from quillspark.llm import queries as Q


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, sf, duck, name):
    df = Q.queries()[name](spark, sf)
    names = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in names)) for r in df.collect())
    res = duck.execute(Q.oracle_sql()[name])
    at = [[d[0] for d in res.description].index(c) for c in names]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in res.fetchall())
    if name.startswith("shards"):
        assert len({r["shard"] for r in df.collect()}) > 1
