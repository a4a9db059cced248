"""Every registered query against its SQL twin on the smallest tables."""

import math
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from curveframe.plans.registry import ORACLES, QUERIES

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return connection


def cell(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, (list, tuple)):
        return tuple(cell(item) for item in value)
    return value


def ordered(columns, rows):
    places = [columns.index(name) for name in sorted(columns)]
    picked = [tuple(cell(row[place]) for place in places) for row in rows]
    return sorted(picked, key=lambda row: [(item is None, str(item)) for item in row])


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries())
    assert set(ORACLES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    frame = queries()[name](spark, FOLDER)
    found = ordered(frame.columns, [tuple(row) for row in frame.collect()])
    answer = duck.execute(oracle_sql()[name])
    columns = [item[0] for item in answer.description]
    assert sorted(columns) == sorted(frame.columns)
    assert found == ordered(columns, answer.fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0
