"""Queries with SQL checks, as the driver compares them."""

import duckdb
import pytest

from pagemill.llm import oracles, queries

SQL = oracles.oracle_sql()
TABLES = ("documents", "pages", "benchmark", "labels", "conversations")


def _plain(value):
    return f"{value:.6f}" if isinstance(value, float) else repr(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    frame = queries.queries()[name](spark, sf)
    columns = sorted(frame.columns)
    ours = sorted(tuple(_plain(row[c]) for c in columns) for row in frame.collect())
    result = connection.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(_plain(row[names.index(c)]) for c in columns) for row in result.fetchall())
    assert ours == theirs
