"""The training-data pipeline: quality rules, near-duplicates, benchmark leaks, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a stage returns as Parquet in the
shared folder and gives the next stage what it reads back. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, mixing, near_dedup, quality, token_files
from quire.llm.queries import tokenizer_path
from quire.llm.scratch import cut, new_path, text_mb
from quire.sources.tables import table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the quality rules or the trees reject go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6, shingles of five words and a similarity of 0.8: one document of each group stays."""
    return near_dedup.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that contain a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: each document as often as the mix takes it."""
    return mixing.repeated(mixing.mix(docs, into="__mix"), "__mix")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: the documents as token files, read back: (doc_id, start, n_tokens, ids_crc32)."""
    path = new_path(spark, "token-files")
    token_files.write(docs, "doc_id", "text", tokenizer_path(), path, new_path(spark, "token-work"), text_mb(docs, "text"))
    got = token_files.read(spark, path)
    return got.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))


STAGES = [
    ("quality rules", keep_good),
    ("near duplicates", drop_near_duplicates),
    ("benchmark leaks", drop_leaks),
    ("mix", mix),
    ("token files", write_tokens),
]

#: The trees, the near-duplicate search and the tokenizer have no SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
