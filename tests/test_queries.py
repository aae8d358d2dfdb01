"""Every query with SQL against DuckDB on the smallest tables, and the contract of the entry module."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillrock import catalog


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return int(v) if isinstance(v, int) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, duck, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    rel = duck.sql(catalog.SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
