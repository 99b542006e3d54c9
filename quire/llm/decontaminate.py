"""Benchmark decontamination: which documents contain test items.

Containment search by size-partitioned MinHash, turned towards short queries: items are partitioned by
the power of two of their shingle count, and each keeps as many of its smallest shingle hashes (a
bottom-k MinHash) as the largest item of its partition may lose plus one. A document that holds at least
the asked share of an item's shingles then holds one of those hashes for certain, however long it is, so
a single join of document shingles with the sketches finds every candidate. Candidates are verified by
exact containment of shingle texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.native_words import lower_ascii, windows, words
from quire.llm.scratch import bounded, cut, with_rows_of


def _hashes(text: str, size: int):
    return windows(words(lower_ascii(F.col(text))), size, lambda w: F.xxhash64(*w))


def _texts(text: str, size: int):
    return F.array_distinct(windows(words(lower_ascii(F.col(text))), size, lambda w: F.concat_ws(" ", *w)))


def item_sketches(items: DataFrame, size: int, percent: int) -> DataFrame:
    """(item, h): the bottom-k MinHash of each item, k from its size partition."""
    rows = items.select("item", F.explode(F.array_distinct(_hashes("text", size))).alias("h")).distinct()
    sized = rows.withColumn("n", F.count("*").over(Window.partitionBy("item")))
    largest = F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1) - 1
    k = F.floor(largest * (100 - percent) / 100) + 1
    return sized.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy("h"))).where(F.col("r") <= k).select("item", "h")


def contaminated(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", size: int = 5, percent: int = 80
) -> DataFrame:
    """(key, item, n_shared, n_item, containment) for each document with at least ``percent`` of an item's shingles.

    Both sides are lower-cased (A-Z), cut into words at ASCII white space, and compared as sets of shingles of
    ``size`` words. Items or documents with fewer words, null texts and null ids match nothing. Rows that share
    an id count as one text set. Two items with the same text are both reported.
    """
    d = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).where("doc IS NOT NULL")
    i = items.select(F.col(item).alias("item"), F.col("text").alias("text")).where("item IS NOT NULL")
    sketches = bounded(cut(item_sketches(i, size, percent), "leak-sketches"))
    found = d.select("doc", F.explode(_hashes("text", size)).alias("h")).join(sketches, "h").select("doc", "item").distinct()
    found = cut(found, "leak-candidates")
    shingles = cut(i.select("item", F.explode(_texts("text", size)).alias("s")).distinct(), "leak-items")
    sizes = shingles.groupBy("item").agg(F.count("*").alias("n_item"))
    held = with_rows_of(d, cut(found.select("doc").distinct(), "leak-docs"), "doc", "left_semi")
    held = held.select("doc", F.explode(_texts("text", size)).alias("s")).join(bounded(shingles), "s").distinct()
    shared = held.groupBy("doc", "item").agg(F.count("*").alias("n_shared")).join(found, ["doc", "item"], "left_semi")
    return (
        shared.join(sizes, "item")
        .where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
        .select(F.col("doc").alias(key), F.col("item").alias(item), "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))
    )


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without those that contain a test item. Rows with a null id stay."""
    gone = cut(contaminated(docs, items, key, text, item, size, percent).select(key).distinct(), "leak-gone")
    return with_rows_of(docs, gone, key, "left_anti")


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM d),
xs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM i),
n AS (SELECT item_id, count(*) AS n_item FROM xs GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN xs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM m JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n_item"""
