"""Edit journals: append-only entries (id, user, sequence, chapter, ...) with clocks and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed limits of a journal: entries, and bytes of their JSON.
MAX_ENTRIES, MAX_BYTES = 200, 1_048_576


def dedupe(entries: DataFrame, ident: str, order: list[str]) -> DataFrame:
    """One entry of each id: the first by ``order``."""
    first = F.min_by(F.struct(*entries.columns), F.struct(*order)).alias("e")
    return entries.groupBy(F.col(ident).alias("__id")).agg(first).select("e.*")


def vector_clock(entries: DataFrame, key: list[str], user: str, sequence: str) -> DataFrame:
    """(key, user, sequence): the highest sequence of each user."""
    return entries.groupBy(*key, user).agg(F.max(sequence).alias(sequence))


def merge_clocks(a: Column, b: Column) -> Column:
    """Two clocks as maps, the higher count of each user."""
    return F.map_zip_with(a, b, lambda k, x, y: F.greatest(x, y))


def compaction_plan(entries: DataFrame, key: list[str], payload: Column) -> DataFrame:
    """(key, entries, bytes, compact): which journals are over their limits."""
    rows = entries.groupBy(*key).agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.length(payload)), F.lit(0)).alias("bytes"))
    return rows.withColumn("compact", (F.col("entries") > MAX_ENTRIES) | (F.col("bytes") > MAX_BYTES))


def after(entries: DataFrame, position: str, watermark: int) -> DataFrame:
    """Entries past a log position."""
    return entries.where(F.col(position) > watermark)


def fold(entries: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """(key, value, n): state of each key after its entries in order: the last value written."""
    last = F.max_by(value, F.struct(*order)).alias(value)
    return entries.groupBy(*key).agg(last, F.count("*").alias("n"))


def presence(events: DataFrame, user: str, order: list[str], kind: str, leave: str) -> DataFrame:
    """(user, kind): users whose last event isn't a leave."""
    return fold(events, [user], order, kind).select(user, kind).where(F.col(kind) != leave)


def converged(replicas: DataFrame, key: list[str], digest: str) -> DataFrame:
    """(key, same): whether all replicas have the same digest."""
    return replicas.groupBy(*key).agg((F.count_distinct(digest) == 1).alias("same"))


def three_way_entries(base: DataFrame, ours: DataFrame, theirs: DataFrame, ident: str, content: str) -> tuple[DataFrame, DataFrame]:
    """(merged entries, conflicting ids): an id changed differently on both sides is a conflict; everything else is united."""
    from quire.operators.versions import three_way

    rows = three_way(base, ours, theirs, ident, content)
    return rows.where(F.col("action") != "conflict").select(ident, content), rows.where(F.col("action") == "conflict").select(ident)


def snapshot(entries: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """(key, value): what a journal's entries come to, in place of them."""
    return fold(entries, key, order, value).select(*key, value)


def hydrate(base: DataFrame, entries: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """(key, value): a snapshot (key, value) with later entries over it."""
    later = snapshot(entries, key, order, value).withColumnRenamed(value, "__later").withColumn("__has", F.lit(True))
    rows = base.join(later, key, "full")
    return rows.select(*key, F.when(F.col("__has"), F.col("__later")).otherwise(F.col(value)).alias(value))


def exchange(ours: DataFrame, theirs: DataFrame, user: str, sequence: str) -> tuple[DataFrame, DataFrame]:
    """(entries to push, entries to pull): those above what the other side's clock has of their user."""

    def missing(have: DataFrame, other: DataFrame) -> DataFrame:
        clock = vector_clock(other, [], user, sequence).withColumnRenamed(sequence, "__known")
        return have.join(clock, user, "left").where(F.col(sequence) > F.coalesce("__known", F.lit(0))).drop("__known")

    return missing(ours, theirs), missing(theirs, ours)


def ingest(own: DataFrame, remote: DataFrame, ident: str, order: list[str]) -> DataFrame:
    """A journal with a remote one's entries that it doesn't have."""
    return own.unionByName(dedupe(remote, ident, order).join(own.select(ident).distinct(), ident, "left_anti"))
