"""Collects queries and the SQL that states the same result on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Run] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query. ``sql`` is left out where no faithful statement exists."""

    def keep(run: Run) -> Run:
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = sql
        return run

    return keep
