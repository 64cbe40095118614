"""Every registered query against its SQL at the smallest scale."""

import math

import duckdb
import pytest

from __spark_entry__ import entry
from fixtures.market import SOURCE_TABLES
from fixtures.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in SOURCE_TABLES:
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return str(value)[:10] if hasattr(value, "isoformat") else value


def listed(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def test_each_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, FOLDER)
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(found.columns)
    assert listed(found.columns, found.collect()) == listed(names, result.fetchall())


def test_entry(spark):
    assert entry(spark).count() == 28
