"""Spark session for local runs; on a cluster the session comes from the cluster."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession


def build_session(
    cores: int | str = "*", app: str = "bizpanel", settings: Mapping[str, str] | None = None
) -> SparkSession:
    """Local session with adaptive execution and UTC."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in (settings or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
