"""All registered queries of the core, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.plans import data, parsed, recall, search, timestamps

Query = Callable[[SparkSession, str], DataFrame]
MODULES: list = [search, data, parsed, recall, timestamps]


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in MODULES:
        found |= module.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in MODULES:
        found |= module.SQL
    return found


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next(iter(queries().values()))(spark, sf_dir)
