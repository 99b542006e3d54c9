"""Running context, runs, ranks and evictions over ordered rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def carry(rows: DataFrame, key: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``name``: the last non-null value at or before each row of its key."""
    w = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def depth(rows: DataFrame, key: list[str], order: list[str], step: Column, name: str = "depth", part: str | None = None) -> DataFrame:
    """Running sum of +1 and -1 steps, never below zero: the sum less its lowest value so far where that is negative.

    It begins anew in each ``part``, a number that never falls in the order of a key: the lowest value of the last part is the
    minimum by (-part, value), so parts need no order of rows of their own. Steps aren't null.
    """
    w = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("__sum", F.sum(step).over(w))
    low = F.least(F.col("__sum"), F.col("__sum") - step)
    at = -F.col(part) if part else F.lit(0)
    low = F.min(F.struct(at.alias("at"), low.alias("low"))).over(w)["low"]
    return rows.withColumn(name, F.col("__sum") - low).drop("__sum")


def islands(rows: DataFrame, key: list[str], place: str, same: list[str]) -> DataFrame:
    """(key, same, first, length): runs of rows of equal ``same`` in neighbouring places (integers, one row each)."""
    w = W.partitionBy(*key, *same).orderBy(place)
    runs = rows.withColumn("__run", F.col(place) - F.row_number().over(w))
    return runs.groupBy(*key, *same, "__run").agg(F.min(place).alias("first"), F.count("*").alias("length")).drop("__run")


def joined_runs(rows: DataFrame, key: list[str], place: str, word: str) -> DataFrame:
    """(key, phrase): words of neighbouring places joined by a space, gaps by an ellipsis."""
    w = W.partitionBy(*key).orderBy(place)
    lead = F.when(F.lag(place).over(w).isNull(), "").when(F.col(place) - F.lag(place).over(w) == 1, " ").otherwise(" … ")
    parts = rows.withColumn("__part", F.concat(lead, F.col(word)))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(place), F.col("__part"))))
    return parts.groupBy(*key).agg(F.array_join(F.transform(ordered, lambda x: x["__part"]), "").alias("phrase"))


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order (which ends in something unique)."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


#: Rows whose sizes are summed in one range.
RANGE_ROWS = 1_000_000


def evicted(rows: DataFrame, age: list[str], size: Column, limit: int, share: float, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows to delete, oldest first, until what is left is within ``share`` of the limit; none if all are within the limit.

    Two narrow passes find the age up to which rows go, then they are filtered by it: sums of ranges of age (a row for
    each comes to the driver), and the running sum within the one range where the limit is passed. Rows of the same age go
    together.
    """
    narrow = rows.select(F.struct(*age).alias("age"), size.alias("size"))
    total, n = narrow.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if total <= limit:
        return rows.limit(0)
    ranged = narrow.repartitionByRange(max(1, -(-n // range_rows)), "age")
    ranges = sorted(ranged.groupBy(F.spark_partition_id()).agg(F.sum("size").alias("size"), F.max("age").alias("last")).drop("SPARK_PARTITION_ID()").collect(), key=lambda r: r["last"])
    kinds = rows.schema

    def literal(row) -> Column:
        return F.struct(*[F.lit(row[a]).cast(kinds[a].dataType).alias(a) for a in age])

    gone, low, at = 0, None, ranges[-1]
    for r in ranges:
        at = r
        if total - (gone + r["size"]) <= share * limit:
            break
        gone, low = gone + r["size"], r["last"]
    inside = narrow.where(F.col("age") <= literal(at["last"]))
    inside = inside.where(F.col("age") > literal(low)) if low is not None else inside
    before = F.sum("size").over(W.orderBy("age").rowsBetween(W.unboundedPreceding, -1))  # one range
    left = F.lit(total - gone) - F.coalesce(before, F.lit(0))
    last = inside.withColumn("left", left).where(F.col("left") > share * limit).agg(F.max("age").alias("age")).first()["age"]
    return rows.where(F.struct(*age) <= literal(last)) if last is not None else rows.limit(0)


def section_numbers(rows: DataFrame, key: list[str], order: str, marker: str, name: str = "section") -> DataFrame:
    """Numbers of translators' sections from 0: each marker that isn't an end (-e) takes the next; an end has the number of the
    start (-s) that is open, else that of the next."""
    w = W.partitionBy(*key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    ends, starts = F.endswith(marker, F.lit("-e")), F.endswith(marker, F.lit("-s"))
    rows = rows.withColumn("__n", F.coalesce(F.count_if(~ends).over(w), F.lit(0)))
    state = F.when(starts, F.struct(F.col("__n").alias("n"))).when(ends, F.struct(F.lit(None).cast("long").alias("n")))
    open_ = F.last(state, ignorenulls=True).over(w)["n"]
    return rows.withColumn(name, F.when(ends, F.coalesce(open_, F.col("__n"))).otherwise(F.col("__n"))).drop("__n")
