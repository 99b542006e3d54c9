"""Tokens of each document with their place among equal surfaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import tokenize


def token_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per word: (key, idx from 0, surface). Null texts have no words."""
    return docs.select(key, F.posexplode(tokenize(F.col(text))).alias("idx", "surface"))


def with_occurrence(tokens: DataFrame, key: str) -> DataFrame:
    """Adds occurrence (1-based, so far) and occurrences (in all) of each surface within its key."""
    same = W.partitionBy(key, "surface")
    return tokens.withColumn("occurrence", F.row_number().over(same.orderBy("idx")).cast("long")).withColumn(
        "occurrences", F.count(F.lit(1)).over(same)
    )
