"""Training-data queries against their SQL, and row counts of those without."""

from __future__ import annotations

import duckdb
import pytest

from lumiquery.llm import oracle, queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, sql, name):
    df = queries.queries()[name](spark, DATA)
    found = df.collect()
    if name not in oracle.oracle_sql():
        assert found
        return
    want = sql.sql(oracle.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    key = lambda cols, r: tuple(str(round(x, 6) if isinstance(x := r[cols.index(c)], float) else x) for c in order)
    assert sorted(key(df.columns, tuple(r)) for r in found) == sorted(key(want.columns, r) for r in want.fetchall())
