"""Every query with a SQL twin gives the twin's rows, names and types."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from conftest import DATA
from riskflow.checks import all_queries, all_sql

TABLES = """region nation customer supplier part orders lineitem events documents
embeddings pages benchmark labels conversations""".split()

SF_DIR = f"{DATA}/sf0.01"

SQL_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    yield connection
    connection.close()


def _in_order(rows):
    return sorted(rows, key=lambda row: [(value is None, str(value)) for value in row])


@pytest.mark.parametrize("query", sorted(entry_points.oracle_sql()))
def test_query_equals_its_sql(spark, duck, query):
    df = entry_points.queries()[query](spark, SF_DIR)
    columns = sorted(df.columns)
    got = _in_order([tuple(row[c] for c in columns) for row in df.collect()])

    cursor = duck.execute(entry_points.oracle_sql()[query])
    types = {column[0]: str(column[1]) for column in cursor.description}
    names = [column[0] for column in cursor.description]
    rows = cursor.fetchall()
    assert sorted(names) == columns
    assert {c: SQL_TYPES[t] for c, t in df.dtypes} == types
    assert got == _in_order([tuple(row[names.index(c)] for c in columns) for row in rows])
    assert got


def test_every_query_of_the_library_has_a_twin():
    assert entry_points.oracle_sql().keys() <= entry_points.queries().keys()
    assert all_queries().keys() == all_sql().keys()


def test_entry(spark):
    daily = entry_points.entry(spark)
    rows = daily.collect()
    assert sum(r["total_transactions"] for r in rows) == 1000
    assert sum(r["total_fraud_transactions"] for r in rows) == 23
    assert len(rows) == 30
