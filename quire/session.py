"""Session builder with the settings the engine expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "quire", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution. ``conf`` uses ``__`` for dots."""
    cores = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master or "SPARK_MASTER" not in os.environ:
        builder = (
            builder.master(master or f"local[{cores}]")
            .config("spark.sql.shuffle.partitions", cores)
            .config("spark.driver.memory", os.environ.get("QUIRE_DRIVER_MEMORY", "8g"))
            .config("spark.driver.bindAddress", "127.0.0.1")
            .config("spark.driver.host", "127.0.0.1")
        )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
