"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import check_sql
from corpusflow.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in check_sql.TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    result = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    got = check_sql.rows(df.columns, df.collect())
    assert got == check_sql.rows(columns, result.fetchall())


def test_every_query_has_sql_and_entry_runs(spark):
    assert set(QUERIES) == set(SQL) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
