"""A session with the settings that the engine counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "lectern", master: str | None = None, **settings: str) -> SparkSession:
    """The active session or a new one: UTC, adaptive execution with skew joins, Arrow."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    wanted = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in settings.items()}
    for key, value in wanted.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
