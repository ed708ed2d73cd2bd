"""Registry of queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    """Register a query, and the DuckDB SQL over some views that gives the same rows.

    SQL that begins with a comma adds tables of its own to the views.
    """

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = (f"WITH {', '.join(views)} " if views else "") + sql.strip()
        return f

    return add
