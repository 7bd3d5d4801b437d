"""All queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from packsieve.plans import logs, predicates, rates, search, trees

MODULES = (predicates, rates, search, logs, trees)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicates.flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.SQL.items()}
