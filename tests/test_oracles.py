"""Every engine query against its SQL on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from lumiquery.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    return float(x) if hasattr(x, "as_tuple") else x


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(plain(r[i])) for i in order) for r in found)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sql, name):
    df = registry.queries()[name](spark, DATA)
    found = df.collect()
    oracle = registry.oracle_sql().get(name)
    if oracle is None:
        assert found is not None
        return
    want = sql.sql(oracle)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(found, df.columns) == rows(want.fetchall(), want.columns)


def test_flagship(spark):
    got = [r["region"] for r in registry.flagship(spark, DATA).collect()]
    assert got == [r for r in ("UV", "blue", "green", "yellow/orange", "red/NIR") if r in got] and got
