"""Streaming forms of the event log: windowed counts and a journal that ingests each entry once."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def window_counts(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(hour, event_type, n): events in tumbling windows; a window is final once the log is ``late`` past it."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = rows.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("hour"), "event_type", "n")


def ingest_once(entries: DataFrame, ident: str = "event_id", late: str = "2 hours") -> DataFrame:
    """A stream of entries without those whose id came within the watermark before."""
    rows = entries.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark([ident])


def number_entries(entries: DataFrame, user: str = "user_id", order: str = "event_id") -> DataFrame:
    """(user, event_id, sequence): a stream's entries with a sequence that goes on from batch to batch for each user."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(order)  # what one trigger brings for one user
        rows = pd.DataFrame({user: key[0], order: rows[order], "sequence": range(n + 1, n + len(rows) + 1)})
        state.update((n + len(rows),))
        yield rows

    return entries.select(user, order).groupBy(user).applyInPandasWithState(run, f"{user} long, {order} long, sequence long", "n long", "append", GroupStateTimeout.NoTimeout)


def read_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files. A streamed path has to be a folder or a pattern, and the table may be a single file."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for a stream's progress or output, in the shared folder that the session names; a temporary one only
    where that is unset and one process is all there is."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = root or f"file://{tempfile.gettempdir()}/quire-streams"
    return f"{root.rstrip('/')}/quire/{name}-{uuid.uuid4().hex}"


def run_once(stream: DataFrame, out: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, into Parquet files below ``out``, and reads them."""
    spark = stream.sparkSession

    def write(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", folder(spark, "progress")).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], stream.schema)  # there was nothing to read
    return spark.read.schema(stream.schema).parquet(f"{out}/epoch=*")


def window_counts_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windowed counts of the whole log: of each window the last update, as later batches replace earlier ones."""
    stream = window_counts(read_log(spark, sf_dir))
    rows = run_once(stream, folder(spark, "counts"), "update")
    return rows.groupBy("hour", "event_type").agg(F.max("n").alias("n")).select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n")
