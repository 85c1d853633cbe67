"""Registered queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import breakend_queries, event_queries, file_queries, forest_queries, format_queries, interval_queries, sampling_queries

ALL = {**event_queries.QUERIES, **interval_queries.QUERIES, **sampling_queries.QUERIES, **file_queries.QUERIES, **breakend_queries.QUERIES, **forest_queries.QUERIES, **format_queries.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, (fn, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
