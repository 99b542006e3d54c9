"""Passages repeated across documents, by overlapping windows of three lines.

Each window of three consecutive lines is hashed; a window seen before (in a document with a smaller id,
or higher up in the same one) is a repeat, and the lines that repeats cover are removed together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.native_words import let, windows
from quire.llm.scratch import cut

WINDOW = 3
#: A window's occurrences are dealt out over so many partitions.
SALT = 16
BLANK = " \t\r\x0b\f"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row(key: str, text: str) -> Column:
    """What tells rows apart: their id and the hash of their text."""
    return F.struct(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("h"))


def repeated_windows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, pos) of each window that has an earlier occurrence; doc is (id, hash of the text)."""
    trimmed = F.transform(_lines(F.col(text)), lambda x: F.btrim(x, F.lit(BLANK)))
    places = windows(
        trimmed,
        WINDOW,
        lambda w: F.struct(F.xxhash64(F.lit(1), *w).alias("h1"), F.xxhash64(F.lit(2), *w).alias("h2"), (F.concat(*w) != "").alias("said")),
    )
    rows = docs.where(F.col(key).isNotNull()).select(_row(key, text).alias("doc"), F.posexplode(places).alias("pos", "w")).where("w.said")
    rows = cut(rows.select("w.h1", "w.h2", "doc", "pos"), "line-windows")
    first = rows.groupBy("h1", "h2").agg(F.min(F.struct("doc", "pos")).alias("first"), F.max(F.struct("doc", "pos")).alias("last"))
    first = first.where("first < last").select("h1", "h2", "first", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc", "pos"), F.lit(SALT)).cast("int"))
    return salted.join(first, ["h1", "h2", "salt"]).where(F.struct("doc", "pos") > F.col("first")).select("doc", "pos")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", into: str = "line_stats") -> DataFrame:
    """``docs`` with the repeats cut out of ``text``, and a column ``into`` (one of that name is replaced), struct(n_lines, n_removed).

    Lines end at newline characters and are compared without white space at either end; windows of three blank
    lines don't count. Of equal windows the one with the smallest (id, hash of the text, line) stays. A null text stays
    null and counts as one blank line, as an empty one does. Rows with a null id stay as they are. Rows that share an id
    are documents of their own, unless their texts are the same too: these count once, and all keep what one of them keeps.
    """
    flags = repeated_windows(docs, key, text).groupBy("doc").agg(F.collect_set("pos").alias("__pos"))
    flags = flags.select(F.col("doc.id").alias("__doc"), F.col("doc.h").alias("__hash"), "__pos")
    lines = _lines(F.col(text))
    covered = F.array_distinct(F.flatten(F.transform("__pos", lambda p: F.sequence(p, p + WINDOW - 1))))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
    joined = docs.join(flags, (F.col(key) == F.col("__doc")) & (F.xxhash64(F.col(text)) == F.col("__hash")), "left")
    n = F.size(lines).cast("long")
    joined = joined.withColumn("__left", F.when(F.col("__pos").isNotNull(), left))
    stats = F.struct(n.alias("n_lines"), (n - F.coalesce(F.size("__left").cast("long"), n)).alias("n_removed"))
    joined = joined.withColumn(into, F.when(F.col("__left").isNull(), F.struct(n.alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))).otherwise(stats))
    kept = F.array_join(let(lines, lambda x: F.transform("__left", lambda i: F.get(x, i))), "\n")
    return joined.withColumn(text, F.when(F.col("__left").isNull(), F.col(text)).otherwise(kept)).drop("__doc", "__hash", "__pos", "__left")


ORACLE = r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
t AS (SELECT doc_id, list_transform(a, lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))) AS a FROM l),
w AS (SELECT doc_id, unnest(range(1, len(a) - 1)) AS pos, unnest(list_transform(range(1, len(a) - 1), lambda k: a[k:k + 2])) AS s FROM t),
r AS (SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, pos) AS k FROM w WHERE array_to_string(s, '') <> '') WHERE k > 1),
c AS (SELECT DISTINCT doc_id, pos + o AS pos FROM r, (SELECT unnest([0, 1, 2]) AS o)),
e AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS pos, unnest(a) AS line FROM l),
g AS (SELECT e.doc_id, string_agg(line, chr(10) ORDER BY e.pos) FILTER (WHERE c.pos IS NULL) AS txt, count(*) AS n_lines, count(c.pos) AS n_removed
      FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.pos = c.pos GROUP BY e.doc_id)
SELECT doc_id, n_lines, n_removed, md5(coalesce(txt, '')) AS kept_md5 FROM g"""
