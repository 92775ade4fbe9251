"""A session with the settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "corpusloom", **settings: str) -> SparkSession:
    """UTC, ANSI arithmetic and adaptive plans; partitions follow the cluster unless set."""
    builder = SparkSession.builder.appName(name)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for k, v in (base | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
