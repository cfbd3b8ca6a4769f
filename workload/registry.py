"""Where the workload modules file their queries and SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """File ``func`` under ``name``; ``sql`` is what DuckDB runs on the same tables."""

    def file(func: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is filed twice")
        QUERIES[name] = func
        if sql is not None:
            ORACLES[name] = sql
        return func

    return file
