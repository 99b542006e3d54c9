"""Readers for the supplied parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir`` (a file or a folder, on any file system Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
