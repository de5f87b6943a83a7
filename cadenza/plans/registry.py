"""Every registered query of the engine, and the SQL that it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import function_queries, library_queries, matching_queries, source_queries

ALL = library_queries.QUERIES | matching_queries.QUERIES | function_queries.QUERIES | source_queries.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
