"""Sessions with the settings that the engine's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "tallyframe", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI arithmetic and adaptive plans with skew handling; partitions are left to the cluster's own settings."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
