"""A session with the settings that the engine counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "rowmesh", **settings: str) -> SparkSession:
    """Adaptive execution, skew joins and partition coalescing on; anything else as given."""
    conf = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    return SparkSession.builder.appName(name).config(map=conf | settings).getOrCreate()
