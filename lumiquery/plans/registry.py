"""All queries of the engine and their SQL oracles."""

from __future__ import annotations

from . import features, files, measurements, molecules, predictions, reports  # noqa: F401  they register their queries
from .catalog import ORACLES, QUERIES, Query
from .predictions import flagship

__all__ = ["flagship", "oracle_sql", "queries"]


def queries() -> dict[str, Query]:
    """Query name to a callable of (spark, sf_dir)."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL."""
    return dict(ORACLES)
