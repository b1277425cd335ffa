"""All queries of the core by name, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusflow.plans import cleaning_queries, column_queries, evaluation_queries, interval_queries, scoring_queries, split_queries, storage_queries, text_queries

MODULES = (cleaning_queries, text_queries, column_queries, scoring_queries, split_queries, evaluation_queries, interval_queries, storage_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every core query by name."""
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
