"""Working tables in the folder that driver and executors share.

Steps that are read more than once are written here as Parquet, so a lost executor costs a re-read
and never a recomputation of the whole lineage.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it was counted and has at most this many rows of a few numbers each.
BROADCAST_ROWS = 500_000
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where that is unset and one process is all there is."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (root or f"file://{tempfile.gettempdir()}/quire-scratch").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder, deleted when the driver's JVM ends (or earlier, by ``drop``)."""
    path = f"{shared_dir(spark)}/quire/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def drop(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Python on executors gets at most ``BATCH_ROWS`` rows and some ``BATCH_BYTES`` at once from what is run inside, as texts may
    be long."""
    batch = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(min(int(batch), BATCH_ROWS)))
    lower_bytes(spark)
    try:
        yield
    finally:
        spark.conf.set(BATCH, batch)


def lower_bytes(spark: SparkSession) -> None:
    """From now on Python on executors gets some ``BATCH_BYTES`` at once in this session, also from what runs after a function has
    returned. A lower limit stays."""
    now = spark.sql(f"SET {BYTES}").first()["value"]
    if not re.fullmatch(r"\d+b?", now, re.I) or int(now.rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(BYTES, str(BATCH_BYTES))


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` and reads it back: lineage ends here.

    Then the driver's JVM is asked to collect its garbage, as only that lets shuffle files of finished steps go.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a table already written by ``cut``, with a broadcast hint if its count is within ``rows``.

    Beyond that the hint is left off and Spark joins by shuffle, splitting skewed partitions.
    """
    return F.broadcast(df) if df.count() <= rows else df


def with_rows_of(docs: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """Semi or anti join of ``docs`` on ``key`` with a written id table; texts move only if the ids are many."""
    return docs.join(bounded(ids.select(key)), key, how)


def text_mb(docs: DataFrame, text: str) -> float:
    """MB of UTF-8 in a text column (at least a small positive number)."""
    total = docs.select(F.sum(F.octet_length(text).cast("long"))).first()[0]
    return max(total or 0, 1) / 1e6
