"""Every registered query against its SQL on the smallest given tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans.catalog import QUERIES
from tidemark.plans.oracles import ORACLES

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="given tables are not here")


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for name in os.listdir(SF_DIR):
        table = name.removesuffix(".parquet")
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{name}'")
    return db


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, tables, name):
    found = entry.queries()[name](spark, SF_DIR)
    columns = sorted(found.columns)
    rows = sorted(repr(tuple(row)) for row in found.select(*[f"`{column}`" for column in columns]).collect())
    cursor = tables.execute(entry.oracle_sql()[name])
    order = sorted((head[0], i) for i, head in enumerate(cursor.description))
    assert [head for head, _ in order] == columns
    assert rows == sorted(repr(tuple(row[i] for _, i in order)) for row in cursor.fetchall())
