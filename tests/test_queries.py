"""Every query next to its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from check import compare

QUERIES, ORACLE = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob("/root/testdata/sf0.001/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def test_every_check_has_its_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, sf, db, name):
    assert compare(QUERIES[name](spark, sf), db.execute(ORACLE[name]))[1] == []


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[0] == "rowkey" and df.count() > 0
