"""Spark sessions with the settings the engine is planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "frameflow", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution with skew joins, UTC, ANSI arithmetic, streaming state in RocksDB. Partition counts stay with the cluster's defaults."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    } | conf
    builder = SparkSession.builder.appName(app).config(map=settings)
    return (builder.master(master) if master else builder).getOrCreate()
