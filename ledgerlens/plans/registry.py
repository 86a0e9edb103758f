"""Named queries: a DataFrame builder over the tables, and the same question as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.session import configure
from ledgerlens.sources.views import Tables, duckdb_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Tables(configure(spark), folder))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = duckdb_sql(sql)
        return build

    return register


def money_sql(cents: str) -> str:
    """Exact money from integer cents (DuckDB divides decimals as doubles)."""
    return f"CAST(CAST({cents} AS DECIMAL(28,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(28,2))"
