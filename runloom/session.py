"""A session with what the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **more: str) -> SparkSession:
    """Adaptive plans, UTC and Arrow batches small enough for long texts; ``more`` overrides."""
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in more.items()}
    builder = SparkSession.builder.appName("runloom").config(map=conf)
    return (builder.master(master) if master else builder).getOrCreate()
