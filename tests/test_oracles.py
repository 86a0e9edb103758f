"""Every query with an SQL twin returns the same rows in DuckDB on the smallest tables."""

from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry_module
from ledgerlens.sources.views import BASE_TABLES

FOLDER = "/root/testdata/sf0.001"
ORACLES = entry_module.oracle_sql()


def canon(value):
    if isinstance(value, float):
        return repr(round(value, 9))
    if isinstance(value, Decimal):
        return f"{value.normalize():f}"
    return "<null>" if value is None else str(value)


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for table in BASE_TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    frame = entry_module.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted(tuple(canon(r[c]) for c in columns) for r in frame.collect())
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(tuple(canon(r[i]) for i in order) for r in result.fetchall())


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() > 0
