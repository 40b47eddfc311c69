"""The registered training-data queries on the smallest data; those with SQL agree with DuckDB."""

import os

import duckdb
import pytest

from loomtrace.llm import queries

COLUMNS = {
    "p1_found": ["first_seq", "last_seq"], "p2_found": ["table_name", "record_key"], "p3_found": ["path", "line_no", "lang"],
    "p6_found": ["target_id", "doc_id"], "p7_found": ["source"], "p8_found": ["doc_id", "kind"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, data, name):
    df = queries.queries()[name](spark, data)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    got = sorted(tuple(r) for r in df.collect()) if name in COLUMNS else df.collect()
    assert len(got) == len(set(map(str, got)))
    sql = queries.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for f in os.listdir(data):
            con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
        assert got == sorted(con.execute(sql).fetchall())


def test_registered():
    import __spark_entry__ as entry

    assert set(COLUMNS) | {"p4_found", "p5_found"} <= set(entry.queries())


def test_mixture_is_part_of_p7_found(spark, data):
    """The blocks drawn and joined by index decide: the plan keeps them. The draws are written before, for their offsets; the
    slots placed from them and what fills those are in the plan."""
    plan = queries.p7_found(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "tokens" in plan and "filled" in plan and "slots" in plan
