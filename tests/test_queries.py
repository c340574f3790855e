"""Registered queries against DuckDB at the smallest size."""

import glob
import os

import duckdb
import pytest

from vigil import registry, registry_life

QUERIES, ORACLES = registry.QUERIES | registry_life.QUERIES, registry.ORACLES | registry_life.ORACLES
DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_each_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    a, b = QUERIES[name](spark, DIR).toPandas(), duck.execute(ORACLES[name]).df()
    names = sorted(a.columns)
    assert names == sorted(b.columns)
    x, y = (t[names].astype(str).sort_values(names).values.tolist() for t in (a, b))
    assert x == y
