"""Every registered query against its SQL on the smallest tables, and the plan rules they follow."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pagemill.plans import catalog, oracles  # noqa: E402
from pagemill.plans.fixtures import TABLES  # noqa: E402

QUERIES = catalog.queries()
SQL = oracles.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    connection.execute("set TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return repr(value)
    return f"{float(value):.6f}" if abs(value) < 2**53 else str(int(value))


def test_every_query_has_a_check():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, sf, name):
    frame = QUERIES[name](spark, sf)
    columns = sorted(frame.columns)
    ours = sorted(tuple(_plain(row[c]) for c in columns) for row in frame.collect())
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    theirs = sorted(tuple(_plain(row[i]) for i in places) for row in result.fetchall())
    assert ours == theirs
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "PythonUDF" not in plan and "Join Cross" not in plan
