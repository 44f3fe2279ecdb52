"""Registry of the queries outside the training-data subpackage and of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernstone.plans import feedback_queries, packed_fields, search_queries, snippet_queries, store_queries, text_queries

MODULES = [packed_fields, store_queries, text_queries, search_queries, feedback_queries, snippet_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_queries.flagship(spark, sf_dir)
