"""Registry of the queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewright.plans import activity, codework, events, knowledge, relational, representations, sequences, stores  # noqa: F401  they register themselves
from tracewright.plans import checks  # noqa: F401, I001  after the queries that it checks
from tracewright.plans.registry import ORACLES, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temporal chunks of all telemetry, the minimum slice of the engine."""
    return QUERIES["w04_temporal_chunks"](spark, sf_dir)
