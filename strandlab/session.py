"""Session builder with the settings the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "strandlab", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI arithmetic, adaptive plans. On a cluster leave master unset and let spark-submit decide."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    return builder.config(map=defaults | conf).getOrCreate()
