"""Every query with a DuckDB counterpart, on the smallest tables."""

import os

import duckdb
import pytest

from graphloom.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.sql(f"create view {t.removesuffix('.parquet')} as select * from '{DATA}/{t}'")
    return c


def plain(rows, columns, order):
    at = [columns.index(c) for c in order]
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in at) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df, sql = QUERIES[name](spark, DATA), duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns, df.columns) == plain(sql.fetchall(), sql.columns, df.columns)
