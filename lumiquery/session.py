"""Spark session with the settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(name: str = "lumiquery", **settings: str) -> SparkSession:
    """UTC, adaptive execution with skew-join handling; any setting can be overridden."""
    builder = SparkSession.builder.appName(name)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
