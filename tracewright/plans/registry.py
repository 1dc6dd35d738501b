"""Where queries register themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewright.sources.telemetry import Tables, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register f(tables) under name; sql is what DuckDB runs to check it, over the derived tables or the driver's."""

    def put(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = oracle(sql)
        return f

    return put


def check(name: str, sql: str) -> None:
    """SQL for a query that is registered already."""
    if name not in QUERIES:
        raise KeyError(name)
    ORACLES[name] = oracle(sql)
