"""Every registered query against its SQL in DuckDB, on the smallest test tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from registered import spark_queries

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"create view {table} as select * from read_parquet('{FOLDER}/{table}.parquet')")
    return connection


def normal(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 9) + 0.0 if isinstance(r[i], float) else r[i] for i in order)
                   for r in records), key=str)


def test_every_query_has_sql():
    assert spark_queries.QUERIES.keys() <= entry.oracle_sql().keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_spark_equals_sql(spark, database, name):
    frame = entry.queries()[name](spark, FOLDER)
    result = database.execute(entry.oracle_sql()[name])
    names = [column[0] for column in result.description]
    assert sorted(frame.columns) == sorted(names)
    assert normal(frame.columns, frame.collect()) == normal(names, result.fetchall())


def test_flagship(spark):
    assert entry.entry(spark).count() == 100
