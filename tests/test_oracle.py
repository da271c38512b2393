"""Every registered query beside its SQL twin on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry_module
from check_oracle import TABLES, kinds, table_rows

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, SF)
    got_cols, got = table_rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(SQL[name])
    want_cols, want = table_rows([d[0] for d in cur.description], cur.fetchall())
    assert got_cols == want_cols
    assert got == want


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
