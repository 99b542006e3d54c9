"""Questions that blocks of documents ask about keys of the whole corpus.

Texts are written once, dealt into blocks of a few MB and bucketed by block, so later passes meet the
answers without moving the texts again. A pass turns each block into sorted 64-bit keys; keys travel packed,
by ranges of their value (buckets), in which they are sorted. The answer for a block has two bits a key in the block's own
order, whether it occurs twice or more and whether this block is the first that has it, and the rank of each that does.
Every block and bucket has a bounded size: more data makes more of them, and of the rows between them up to one a key.
"""

from __future__ import annotations

import atexit
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.scratch import new_path
from quire.llm.words import tidy

BLOCKS_A_BUCKET = 4
ASKED = "bucket int, block int, n int, keys binary, multi binary"
ANSWERED = "block int, bucket int, pass int, bits binary, lead binary, ranks binary"


def write_blocks(docs: DataFrame, key: str, text: str, total_mb: float, block_mb: float) -> DataFrame:
    """(block, id as text, text) as a written table in which a block's rows lie in one task of every scan."""
    spark = docs.sparkSession
    n_blocks = max(8, math.ceil(total_mb / block_mb))
    n_files = max(2, n_blocks // BLOCKS_A_BUCKET)
    rows = docs.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text"))
    # by the row's number as well, so that a row which is repeated often goes to many blocks
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(n_blocks)).cast("int"))
    name = f"quire_blocks_{uuid.uuid4().hex}"
    writer = rows.repartition(n_files, "block").write.format("parquet").option("compression", "zstd").option("path", new_path(spark, "blocks"))
    writer.bucketBy(n_files, "block").saveAsTable(name)
    _drop_at_exit(name)
    spark.sparkContext._jvm.System.gc()  # as in scratch.cut
    return spark.table(name)


def _drop_at_exit(name: str) -> None:
    """Takes a table of blocks off the catalog when Python ends; its files go with the driver's JVM."""

    def drop() -> None:
        spark = SparkSession.getActiveSession()
        if spark is not None and spark.sparkContext._jsc is not None:
            spark.sql(f"DROP TABLE IF EXISTS {name}")

    atexit.register(drop)


def pack(keys: np.ndarray) -> bytes:
    """Numbers in planes of 16 bits, as many as the largest needs, after a byte with their count: of sorted or small numbers
    the upper planes hardly change, which compresses well."""
    planes = max(1, -(-int(keys.max()).bit_length() // 16)) if len(keys) else 1
    parts = [((keys >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.uint16).tobytes() for k in range(planes)]
    return bytes([planes]) + b"".join(parts)


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint16, offset=1).reshape(blob[0], -1)
    out = planes[0].astype(np.uint64)
    for k in range(1, blob[0]):
        out |= planes[k].astype(np.uint64) << np.uint64(16 * k)
    return out


def by_range(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) for the buckets that sorted keys have; each is a range of values."""
    bucket = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(keys) else np.zeros(1, np.int64)
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(bucket[i]), i, j


def ask(block: int, keys: np.ndarray, buckets: int) -> pd.DataFrame:
    """The rows that ask whether keys occur twice or more in the corpus. keys: all of a block's, in any order."""
    u, n = np.unique(keys, return_counts=True)
    rows = [(b, block, j - i, pack(u[i:j]), np.packbits(n[i:j] > 1).tobytes()) for b, i, j in by_range(u, buckets)]
    return pd.DataFrame(rows, columns=["bucket", "block", "n", "keys", "multi"])


def answer(asked: DataFrame, number: int) -> DataFrame:
    """For each asking row, two bits for each key: whether it occurs twice or more over all blocks, and nowhere in a smaller
    block; and the ranks, from 0, of those that do among all such of the bucket."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        keys = np.concatenate([unpack(k) for k in pdf["keys"]])
        twice = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(pdf["multi"], pdf["n"], strict=True)]).astype(bool)
        order = np.argsort(keys, kind="stable")
        new = np.concatenate(([True], keys[order[1:]] != keys[order[:-1]]))
        of = np.cumsum(new) - 1
        tied = np.logical_or.reduceat(twice[order], np.flatnonzero(new)) | (np.diff(np.append(np.flatnonzero(new), len(keys))) > 1)
        rank = np.empty(len(keys), np.uint64)
        rank[order] = (np.cumsum(tied) - 1).astype(np.uint64)[of]
        twice[order], lead = tied[of], np.zeros(len(keys), bool)
        lead[order[new]] = True
        ends = np.cumsum(pdf["n"].to_numpy())
        at = [slice(e - n, e) for e, n in zip(ends, pdf["n"], strict=True)]
        bits, leads = ([np.packbits(x[k]).tobytes() for k in at] for x in (twice, lead))
        return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "pass": np.int32(number), "bits": bits, "lead": leads, "ranks": [pack(rank[k][twice[k]]) for k in at]})

    return by_bucket(asked, run, ANSWERED)


def hear(answers: pd.DataFrame, number: int, keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of a block's keys, from the answers to pass ``number``: 0 if it occurs once only, else its rank, from 1, among
    all keys that don't; and whether this is its first occurrence (in the first block that has it, and there at the lowest
    place). Equal ranks are equal keys, and greater ones greater keys."""
    order = np.argsort(keys, kind="stable")
    new = np.concatenate(([True], keys[order[1:]] != keys[order[:-1]])) if len(keys) else np.zeros(0, bool)
    u = keys[order[new]]
    mine = answers[answers["pass"] == number]
    told = dict(zip(mine["bucket"], zip(mine["bits"], mine["lead"], mine["ranks"], strict=True), strict=True))
    rank, leads = np.zeros(len(u), np.uint64), np.zeros(len(u), bool)
    for b, i, j in by_range(u, buckets):
        bits, lead, ranks = told[b]
        twice = np.unpackbits(np.frombuffer(bits, np.uint8), count=j - i).astype(bool)
        leads[i:j] = np.unpackbits(np.frombuffer(lead, np.uint8), count=j - i).astype(bool)
        rank[i:j][twice] = unpack(ranks) + np.uint64((b << 32) + 1)
    out, first = np.empty(len(keys), np.uint64), np.zeros(len(keys), bool)
    out[order] = rank[np.cumsum(new) - 1]
    first[order[new]] = leads
    return out, first


def with_answers(table: DataFrame, answers: DataFrame | None, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """run(a block's rows, its answers) for each block."""

    def both(rows: pd.DataFrame, heard: pd.DataFrame) -> pd.DataFrame:
        out = run(rows, heard)
        tidy()
        return out

    if answers is None:
        return table.groupBy("block").applyInPandas(lambda rows: both(rows, pd.DataFrame(columns=["pass"])), schema)
    return table.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(both, schema)


def by_bucket(asked: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """run(all that is asked in a bucket) for each bucket."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        out = run(rows)
        tidy()
        return out

    return asked.groupBy("bucket").applyInPandas(one, schema)
