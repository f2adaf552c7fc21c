"""Registered queries against their DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

from boscage.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def same(spark, queries, oracle, name):
    got = queries[name](spark, SF).toPandas()
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    want = con.sql(oracle[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda df: sorted(tuple(str(round(x, 6) + 0.0) if isinstance(x, float) else str(x) for x in row) for row in df[columns].itertuples(index=False))
    assert key(got) == key(want)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    same(spark, QUERIES, ORACLE, name)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
