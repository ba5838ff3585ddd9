"""Query registry: each entry pairs a Spark query with its DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from statfold.sources.tables import table

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``sql`` is omitted for rows-only checks."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


class Tables:
    """Lazy accessor: ``T(spark, sf).lineitem``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._sf = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self._spark, self._sf, name)
