"""Every registered query against its SQL at the smallest scale."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from pdwatch.catalog.oracle import ORACLE
from pdwatch.catalog.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in os.listdir(FOLDER):
        connection.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert entry(spark).count() == 1


def test_bootstrap(spark):
    assert queries()["bootstrap_sample"](spark, FOLDER).count() == 500


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    frame = queries()[name](spark, FOLDER)
    relation = tables.sql(oracle_sql()[name])
    columns = sorted(frame.columns)
    assert columns == sorted(relation.columns)
    order = [relation.columns.index(c) for c in columns]
    mine = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)
    theirs = sorted((tuple(r[i] for i in order) for r in relation.fetchall()), key=repr)
    assert mine == theirs


def test_given_tables_reach_every_level_of_the_index(spark):
    rows = queries()["psi_levels"](spark, FOLDER).collect()
    assert {r["feature"]: r["status"] for r in rows} == {"discount": "NORMAL", "volume": "WARNING", "quantity": "ALERT"}
