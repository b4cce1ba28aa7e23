"""The contract file: every oracle agrees at the smallest scale, every query runs."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import key, norm

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def test_flagship(spark):
    assert len(entry.entry(spark).take(1)) == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in df.columns]
    want = sorted((tuple(norm(r[i]) for i in order) for r in rel.fetchall()), key=key)
    got = sorted((tuple(norm(x) for x in r) for r in df.collect()), key=key)
    assert got == want
