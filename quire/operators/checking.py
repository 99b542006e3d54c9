"""Checking records: entries that supersede others, checklists, comments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.windows import latest


def active(entries: DataFrame, key: list[str], ident: str, supersedes: str) -> DataFrame:
    """Entries that no other entry supersedes."""
    gone = entries.where(F.col(supersedes).isNotNull()).select(*key, F.col(supersedes).alias(ident)).distinct()
    return entries.join(gone, [*key, ident], "left_anti")


def for_reference(entries: DataFrame, ref: str, prefix: str) -> DataFrame:
    return entries.where(F.startswith(F.col(ref), F.lit(prefix)))


def coverage_items(books: DataFrame, key: str, verses: str) -> DataFrame:
    """(key, verse, id, status): one pending item for each verse of each book."""
    rows = books.where(F.col(verses) > 0).select(key, F.explode(F.sequence(F.lit(1), F.col(verses))).alias("verse"))
    return rows.select(key, "verse", F.concat_ws(":", F.col(key).cast("string"), F.col("verse").cast("string")).alias("id"), F.lit("pending").alias("status"))


def merge_items(items: DataFrame, more: DataFrame, ident: str) -> DataFrame:
    """Both lists; of equal ids the first list's item."""
    return items.unionByName(more.join(items.select(ident), ident, "left_anti"))


def update_status(items: DataFrame, patch: DataFrame, ident: str) -> DataFrame:
    """Items with the status of the patch where it has their id."""
    rows = items.join(patch.select(ident, F.col("status").alias("__s")), ident, "left")
    return rows.withColumn("status", F.coalesce("__s", "status")).drop("__s")


def upsert(rows: DataFrame, more: DataFrame, key: list[str]) -> DataFrame:
    """Rows with those of the same key replaced by newer ones."""
    both = rows.withColumn("__new", F.lit(0)).unionByName(more.withColumn("__new", F.lit(1)))
    return latest(both, key, [F.col("__new").desc()]).drop("__new")


def read_stages(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, id, label, order, description, checklists) of the valid stages of JSON workflows: with id, label and order."""
    kind = "stages array<struct<id: string, label: string, order: double, description: string, defaultChecklists: array<string>>>"
    r = rows.select(key, F.explode(F.from_json(text, kind)["stages"]).alias("s"))
    r = r.select(key, F.trim("s.id").alias("id"), F.trim("s.label").alias("label"), F.col("s.order").alias("order"), F.col("s.description").alias("description"), F.col("s.defaultChecklists").alias("checklists"))
    return r.where("id <> '' AND label <> '' AND order IS NOT NULL")


def ordered_stages(stages: DataFrame) -> DataFrame:
    """Stages in order (order, then id)."""
    return stages.orderBy("order", "id")


def stage_by_id(stages: DataFrame, ident: str) -> DataFrame:
    return stages.where(F.col("id") == ident)


def read_threads(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, book, id, ref, resolved, comments) of JSON comment files; files without a book have no rows."""
    kind = "book string, threads array<struct<id: string, ref: string, resolved: boolean, comments: array<struct<author: string, text: string, timestamp: string>>>>"
    r = rows.select(key, F.from_json(text, kind).alias("d")).where("d.book <> ''")
    return r.select(key, F.upper("d.book").alias("book"), F.explode("d.threads").alias("t")).select(key, "book", "t.*")


def read_decisions(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, book, id, ref, decision, author, timestamp) of JSON decision files; files without a book have no rows."""
    kind = "book string, decisions array<struct<id: string, ref: string, decision: string, author: string, timestamp: string>>"
    r = rows.select(key, F.from_json(text, kind).alias("d")).where("d.book <> ''")
    return r.select(key, F.upper("d.book").alias("book"), F.explode("d.decisions").alias("t")).select(key, "book", "t.*")


def write_file(rows: DataFrame, key: list[str], items: str) -> DataFrame:
    """(key, text): each book's rows as one JSON file, ``book`` and the list ``items``, in order of id."""
    item = F.struct("id", *[c for c in rows.columns if c not in ("id", "book", *key)])
    return rows.groupBy(*key, "book").agg(F.array_sort(F.collect_list(item)).alias(items)).select(*key, F.concat(F.to_json(F.struct("book", items)), F.lit("\n")).alias("text"))


def instantiate(templates: DataFrame, session: str, stage: str) -> DataFrame:
    """(session, stage, template, label, item_type, id, item_label, criteria, status) from JSON checklist templates (text): a
    pending item for each of a template's."""
    kind = "id string, label string, itemType string, termRef string, templateItems array<struct<id: string, label: string, criteria: string>>"
    t = templates.select(F.from_json("text", kind).alias("t")).select("t.*", F.explode("t.templateItems").alias("i"))
    return t.select(F.lit(session).alias("session"), F.lit(stage).alias("stage"), F.col("id").alias("template"), "label", F.col("itemType").alias("item_type"), F.col("termRef").alias("term_ref"), F.col("i.id").alias("item"), F.col("i.label").alias("item_label"), F.col("i.criteria").alias("criteria"), F.lit("pending").alias("status"))
