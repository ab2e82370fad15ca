"""Registry of the engine's queries, each with the SQL that an independent engine can check it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from specula.plans import catalog_queries, frame_queries, kernel_queries, stat_queries, stream_queries

MODULES = (catalog_queries, frame_queries, stat_queries, kernel_queries, stream_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for m in MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame_queries.flagship(spark, sf_dir)
