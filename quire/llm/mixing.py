"""Mixing sources to target weights.

Each source wants a share of the budget by weight, but at most ``max_epochs`` passes over what it has;
what it can't use goes to the others by weight, until none is above its limit (capped water-filling).
Sorted by limit / weight, the sources at their limit are a prefix, so the level comes from running sums
over the table of sources. Within a source each document is taken as many whole times as the target
covers the source, and the rest of the target is filled with documents in the order of a seeded hash of id and
text, and of their row where these are the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.native_words import count_words
from quire.llm.scratch import bounded, cut

#: Hash ranges a source's documents are summed in before the exact cut is looked for within one of them.
BUCKETS = 4096
HASH_BITS = 48


def _place(key: str, text: str, seed: int):
    """A seeded number below 2**48 for each id and text."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


#: Rows are numbered within their partition of the scan; the partition is in the upper bits.
ROW_BITS = 33


def _bucket(place):
    return F.floor(place / (2**HASH_BITS // BUCKETS)).cast("int")


def _with(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Joins tables that both have a source, which may be null."""
    right = right.withColumnRenamed("source", "__source")
    return left.join(right, left["source"].eqNullSafe(right["__source"]), how).drop("__source")


def targets(sizes: DataFrame, weights: list[float], share: float, max_epochs: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weights go round the sources by code point, null last.

    The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights))
    rows = sizes.withColumn("w", w).withColumn("most", F.lit(float(max_epochs)) * F.col("source_size"))
    rows = rows.withColumn("at", F.col("most") / F.col("w"))
    order = Window.orderBy("at", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.lit(float(share)) * F.sum("source_size").over(every)
    level = (budget - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after)
    # the water level is that of the first source which it doesn't fill; without one, all are full
    rows = rows.withColumn("level", level)
    rows = rows.withColumn("level", F.first(F.when(F.col("level") <= F.col("at"), F.col("level")), ignorenulls=True).over(every))
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("level") * F.col("w")))
    return rows.select("source", "source_size", target.alias("target"))


def _cut(rows: DataFrame, cuts: DataFrame, by: str) -> DataFrame:
    """For each source of ``cuts`` (source, held, rest): the value of ``by`` whose rows hold the place where ``rest`` words are
    filled, and the words held before it. ``rows`` has (source, by, words)."""
    sums = rows.groupBy("source", by).agg(F.sum("words").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy(by))
    sums = _with(sums.withColumn("upto", upto), cuts.select("source", "held", "rest"), "inner").withColumn("upto", F.col("held") + F.col("upto"))
    found = sums.where("upto > rest AND upto - words <= rest").select("source", by, (F.col("upto") - F.col("words")).alias("held"), "rest")
    return bounded(cut(found, f"mix-{by}"))


def mix_plan(narrow: DataFrame, weights: list[float], share: float, max_epochs: int) -> DataFrame:
    """One row per source of ``narrow`` (source, words, place, row): its target, whole passes, and where the last part pass ends,
    ``last`` (place, row).

    The end is looked for in ranges of places, then among the places of one range, among the scan's partitions that
    have rows of one place, and among the rows of one partition.
    """
    narrow = narrow.withColumns({"bucket": _bucket(F.col("place")), "part": F.shiftright("row", ROW_BITS)})
    sums = cut(narrow.groupBy("source", "bucket").agg(F.sum("words").alias("words")), "mix-sums")
    goal = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(0)
    goal = goal.withColumn("whole", whole.cast("long")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    goal = bounded(cut(goal, "mix-goal"))
    at = goal.select("source", F.lit(0).cast("long").alias("held"), "rest")
    inside, found = narrow, goal.select("source")
    for by, rows in (("bucket", sums), ("place", None), ("part", None)):
        at = _cut(inside if rows is None else rows, at, by)
        found = _with(found, at.select("source", by), "left")
        inside = _with(inside, at.select("source", F.col(by).alias("__at")), "inner").where(F.col(by) == F.col("__at")).drop("__at")
    upto = F.col("held") + F.sum("words").over(Window.partitionBy("source").orderBy("row"))
    ends = _with(inside, at.select("source", "held", "rest"), "inner").withColumn("upto", upto)
    taken = ends.where("upto <= rest OR upto - words <= rest AND upto - rest <= rest - (upto - words)")
    last = bounded(cut(taken.groupBy("source").agg(F.max("row").alias("row")), "mix-last"))
    edge = F.struct("place", F.coalesce("row", F.shiftleft("part", ROW_BITS) - 1).alias("row"))
    found = _with(cut(found, "mix-edge"), last, "left").select("source", F.when(F.col("place").isNotNull(), edge).alias("last"))
    return _with(goal, bounded(cut(found, "mix-found")), "left")


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: int = 2,
    seed: int = 1,
    into: str = "mix",
) -> DataFrame:
    """``docs`` with a column ``into`` (one of that name is replaced), struct(size, source_size, target, copies, taken): how often each document goes into the mix.

    size counts the words of a text (null: 0); the budget is ``share`` times all words. A source's copies fill its
    target to within half of one document. Null is a source like others, sorted last. Sources without words have
    target 0 and no copies. Rows with the same id and text are told apart by their place in ``docs``, whose partitions have
    to come out the same when read again, as those of files do. No rows give no rows. A rerun takes the same documents.
    """
    size = count_words(F.col(text))
    here = {"__size": size, "__place": _place(key, text, seed), "__row": F.monotonically_increasing_id()}
    narrow = docs.select(F.col(source).alias("source"), *[c.alias(n) for n, c in zip(("words", "place", "row"), here.values(), strict=True)])
    plan = bounded(cut(mix_plan(cut(narrow, "mix-narrow"), list(weights), share, max_epochs), "mix-plan"))
    plan = plan.select([F.col(c).alias(f"__of_{c}") for c in plan.columns])
    rows = docs.withColumns(here).join(plan, F.col(source).eqNullSafe(F.col("__of_source")), "left")
    early = F.struct(F.col("__place").alias("place"), F.col("__row").alias("row")) <= F.col("__of_last")
    once_more = F.when(F.col("__of_rest") <= 0, False).when(F.col("__of_last").isNull(), True).otherwise(early)
    copies = F.least(F.col("__of_whole") + once_more.cast("long"), F.lit(max_epochs).cast("long"))
    rows = rows.withColumn("__copies", copies)
    made = F.struct(
        F.col("__size").alias("size"),
        F.col("__of_source_size").alias("source_size"),
        F.col("__of_target").alias("target"),
        F.col("__copies").alias("copies"),
        (F.col("__copies") * F.col("__size")).alias("taken"),
    )
    return rows.withColumn(into, made).drop(*here, "__copies", *plan.columns)


def repeated(mixed: DataFrame, into: str = "mix") -> DataFrame:
    """The mix itself: each row of ``mix``'s result as often as it is taken, without the column of the mix."""
    copies = F.sequence(F.lit(1).cast("long"), F.col(into)["copies"])
    rows = mixed.where(F.col(into)["copies"] > 0).withColumn("__copy", F.explode(copies))
    return rows.drop(into, "__copy")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  CAST('0x' || substr(md5('1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 12) AS BIGINT) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM s),
a AS (SELECT *, 2.0::DOUBLE * source_size AS most, 2.0::DOUBLE * source_size / w AS ratio FROM w),
l AS (SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
                 - coalesce(sum(most) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
                / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM a),
f AS (SELECT arg_min(level, k) AS level FROM (SELECT *, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS k FROM l) WHERE level <= ratio),
t AS (SELECT l.source, l.source_size, CASE WHEN f.level IS NULL THEN most ELSE least(most, f.level * w) END AS target FROM l, f),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(least(floor(target / source_size), 2) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (SELECT d.*, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS rest,
             CAST(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id) AS BIGINT) AS upto
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * least(2, whole + CASE WHEN rest > 0 AND (upto <= rest OR upto - size <= rest AND upto - rest <= rest - (upto - size)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r"""
