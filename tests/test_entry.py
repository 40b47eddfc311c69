"""Every registered query of the core runs on the smallest data; those with SQL agree with DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from loomtrace.plans import registry


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return ""
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(plain(float(v)) if isinstance(v, int) and not isinstance(v, bool) else plain(v) for v in r) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, data, duck, name):
    got = registry.queries()[name](spark, data).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is not None:
        want = duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
