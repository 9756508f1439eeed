"""A session with the settings this library is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "normloom", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution with skew handling, UTC, Arrow; ``conf`` overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
