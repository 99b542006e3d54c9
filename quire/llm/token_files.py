"""Token ids of a corpus in byte-aligned variable-length files.

Ids are replaced by their rank in frequency, so common ones take one byte. Four ranks share a control byte
(two bits each: its length less one); control bytes and rank bytes are kept apart, so a block is decoded by
looking all control bytes up in a table of lengths and gathering the bytes, without a loop over tokens.

A file set is a folder with ``blocks`` (runs of documents in id order: ids, lengths, control and data bytes),
``index`` (the first token of each block) and ``ranks`` (the id of each rank).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.pieces import encoder
from quire.llm.scratch import bounded, lower_bytes, small_batches
from quire.llm.words import tidied

#: A block closes after the slice of texts in which it has got so many tokens.
BLOCK_TOKENS = 100_000
PART_MB = 40
#: Texts handled at once.
SLICE = 250
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of non-negative numbers below 2**32."""
    code = (ranks > 0xFF).astype(np.uint8)
    widest = int(ranks.max()) if len(ranks) else 0
    for limit in (0xFFFF, 0xFFFFFF):
        if widest > limit:
            code += ranks > limit
    width = int(code.max()) + 1 if len(code) else 1
    wide = np.ascontiguousarray(ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width])
    data = wide.ravel()[(np.arange(width, dtype=np.uint8) <= code[:, None]).ravel()]
    four = np.zeros((-(-len(ranks) // 4), 4), np.uint8)
    four.ravel()[: len(ranks)] = code
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    return control.tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n numbers that ``encode`` was given."""
    length = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    start = np.cumsum(length, dtype=np.int64) - length
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[start].astype(np.uint32)
    for k in range(1, int(length.max()) if n else 1):
        out |= np.where(length > k, raw[start + k], 0).astype(np.uint32) << np.uint32(8 * k)
    return out


BLOCKS = "part int, block int, ids array<long>, lengths array<long>, tokens binary"
#: The block number of the row that holds a part's counts: its ids are token ids, its lengths how often each occurs.
COUNTS = -1


def tokenize(docs: DataFrame, key: str, text: str, tokenizer: str, n_parts: int) -> DataFrame:
    """Blocks of documents in ascending id order (ties by text, nulls first), with their token ids as 32-bit numbers."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(n_parts, "id", F.xxhash64("text")).sortWithinPartitions("id", "text")
    rows = rows.select(F.spark_partition_id().alias("part"), "id", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts, block, part, ids, lengths, tokens, size = encoder(tokenizer), 0, None, [], [], [], 0
        seen = np.zeros(encode_texts.vocabulary, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                part = piece["part"][0].as_py()
                made, n = encode_texts(piece["text"].to_pylist())
                seen += np.bincount(made, minlength=len(seen))
                ids.append(piece["id"].to_numpy(zero_copy_only=False) if piece["id"].null_count == 0 else piece["id"].to_pylist())
                lengths.append(n)
                tokens.append(made)
                size += len(made)
                if size >= BLOCK_TOKENS:
                    yield _block(part, block, ids, lengths, tokens)
                    block, ids, lengths, tokens, size = block + 1, [], [], [], 0
        if ids:
            yield _block(part, block, ids, lengths, tokens)
        if part is not None:
            found = np.flatnonzero(seen)
            yield _block(part, COUNTS, [found], [seen[found]], [np.zeros(0, np.uint32)])

    return rows.mapInArrow(tidied(run), BLOCKS)


def _block(part: int, block: int, ids: list, lengths: list[np.ndarray], tokens: list[np.ndarray]) -> pa.RecordBatch:
    one = lambda lists: pa.ListArray.from_arrays([0, sum(map(len, lists))], pa.concat_arrays([pa.array(x, pa.int64()) for x in lists]))
    columns = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), one(ids), one(lengths), pa.array([np.concatenate(tokens).astype("<u4").tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["part", "block", "ids", "lengths", "tokens"])


def write(docs: DataFrame, key: str, text: str, tokenizer: str, path: str, work: str, total_mb: float) -> None:
    """Writes the file set of ``docs`` below ``path``. ``work`` is a folder for the ids until their ranks are known.

    Each document's ids end with END_ID. Null and empty texts have that one alone. Rows with the same id follow each
    other by text; null ids come first. No rows give an empty set.
    """
    spark = docs.sparkSession
    n_parts = max(2, int(np.ceil(total_mb / PART_MB)))
    with small_batches(spark):
        tokenize(docs, key, text, tokenizer, n_parts).write.option("compression", "zstd").parquet(work)
    made = spark.read.schema(BLOCKS).parquet(work)
    raw = made.where(F.col("block") != COUNTS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(0, np.int64)
        for batch in batches:
            if batch.num_rows:
                more = np.bincount(batch["ids"].flatten().to_numpy(), batch["lengths"].flatten().to_numpy())
                n, small = (more, n) if len(more) > len(n) else (n, more)
                n[: len(small)] += small
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n[found].astype(np.int64), pa.int64())], ["id", "n"])

    counts = made.where(F.col("block") == COUNTS).select("ids", "lengths").mapInArrow(add, "id long, n long")
    counts = counts.groupBy("id").agg(F.sum("n").alias("n"))
    # one row for each id that occurs: at most the tokenizer's vocabulary
    ordered = counts.orderBy(F.desc("n"), "id").toPandas()
    ids = ordered["id"].to_numpy(np.int64)
    spark.createDataFrame(pd.DataFrame({"rank": np.arange(len(ids)), "id": ids}), "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(ids.max() + 1 if len(ids) else 1, np.uint32)
    rank[ids] = np.arange(len(ids))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                made = encode(rank[np.frombuffer(row["tokens"][0].as_buffer(), "<u4")])
                columns = [row[c] for c in ("part", "block", "ids", "lengths")] + [pa.array([x], pa.binary()) for x in made]
                yield pa.RecordBatch.from_arrays(columns, ["part", "block", "ids", "lengths", "control", "data"])

    lower_bytes(spark)
    raw.mapInArrow(tidied(code), BLOCKS.replace("tokens binary", "control binary, data binary")).write.parquet(f"{path}/blocks")
    sizes = raw.select("part", "block", F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x).alias("n"))
    in_part = F.sum("n").over(Window.partitionBy("part").orderBy("block")) - F.col("n")
    whole = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    # one row for each part
    before = whole.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    starts = sizes.withColumn("inside", in_part).join(before, "part").select("part", "block", (F.col("before") + F.col("inside")).alias("start"))
    starts.write.parquet(f"{path}/index")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, tokens) for each document of a file set: tokens holds its ids as little-endian 32-bit numbers."""
    lower_bytes(spark)
    ranks = spark.read.schema("rank long, id long").parquet(f"{path}/ranks").orderBy("rank").toPandas()
    ids = ranks["id"].to_numpy(np.uint32)
    blocks = spark.read.schema(BLOCKS.replace("tokens binary", "control binary, data binary")).parquet(f"{path}/blocks")
    index = spark.read.schema("part int, block int, start long").parquet(f"{path}/index")
    blocks = blocks.join(bounded(index), ["part", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                n = row["lengths"].flatten().to_numpy()
                ends = np.cumsum(n)
                tokens = ids[decode(row["control"][0].as_buffer(), row["data"][0].as_py(), int(ends[-1]))].astype("<u4")
                cut = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.concatenate(([0], 4 * ends)).astype(np.int32)), pa.py_buffer(tokens)])
                start = pa.array(row["start"][0].as_py() + ends - n, pa.int64())
                yield pa.RecordBatch.from_arrays([row["ids"].flatten(), start, row["lengths"].flatten(), cut], ["id", "start", "n_tokens", "tokens"])

    return blocks.mapInArrow(tidied(run), "id long, start long, n_tokens long, tokens binary")
