"""Verses addressed by ranges that may go over chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for the last verse of a chapter.
END = 2_147_483_647


def read_ranges(rows: DataFrame, ref: str) -> DataFrame:
    """``rows`` with book, chapter, verse, to_chapter, to_verse of a reference: a verse (``TIT 1:2``), verses (``TIT 1:2-5``), a chapter
    (``TIT 1``), chapters (``TIT 1-3``) or verses over chapters (``TIT 1:2-3:4``). All are null where it is none of these, or ends
    before it begins."""
    pattern = r"^(\w{3})\s+(\d+)(?::(\d+))?(?:-(?:(\d+):)?(\d+))?$"
    names = ("book", "chapter", "verse", "over", "last")

    def parts(text: Column) -> Column:
        part = lambda k: F.regexp_extract(text, pattern, k)  # noqa: E731  (an empty part has no number)
        return F.struct(*[(part(k) if k == 1 else part(k).try_cast("int")).alias(n) for k, n in enumerate(names, 1)])

    def span(p: Column) -> Column:
        chapter, verse, over, last = (p[n] for n in names[1:])
        whole = verse.isNull()
        to_chapter = F.when(over.isNotNull(), over).when(whole & last.isNotNull(), last).otherwise(chapter)
        to_verse = F.when(whole & over.isNull(), F.lit(END)).otherwise(F.coalesce(last, verse))
        return F.struct(p["book"].alias("book"), chapter.alias("chapter"), F.coalesce(verse, F.lit(0)).alias("verse"), to_chapter.alias("to_chapter"), to_verse.alias("to_verse"))

    def ordered(x: Column) -> Column:
        good = x["chapter"].isNotNull() & (F.struct(x["to_chapter"].alias("c"), x["to_verse"].alias("v")) >= F.struct(x["chapter"].alias("c"), x["verse"].alias("v")))
        return F.when(good, x)

    # a list of one, step by step: so each text is taken apart once and not once for each place where a part of it is used
    found = F.array(F.upper(F.trim(F.regexp_replace(ref, r"\s*[-–—]\s*", "-"))))
    for step in (parts, span, ordered):
        found = F.transform(found, step)
    return rows.select("*", F.inline_outer(found))


def verses_in(ranges: DataFrame, verses: DataFrame) -> DataFrame:
    """Columns of ``ranges`` (book, chapter, verse, to_chapter, to_verse, ...) and ``verses`` (book, chapter, verse, ...) for each verse
    in each range; those of the verses as at_chapter and at_verse.

    A range is split into its chapters, which meet the verses by equality: inside a chapter only its first and last one bound the
    verses. So work grows with what ranges hold, and a long range spreads over its chapters. Ranges and verses without a number
    meet nothing.
    """
    chapters = F.explode(F.sequence("chapter", "to_chapter"))
    split = ranges.where("chapter IS NOT NULL AND to_chapter >= chapter").withColumn("at_chapter", chapters)
    low = F.when(F.col("at_chapter") == F.col("chapter"), F.col("verse")).otherwise(F.lit(0))
    high = F.when(F.col("at_chapter") == F.col("to_chapter"), F.col("to_verse")).otherwise(F.lit(END))
    split = split.withColumns({"__low": low, "__high": high})
    there = verses.withColumnsRenamed({"chapter": "at_chapter", "verse": "at_verse"})
    return split.join(there, ["book", "at_chapter"]).where("at_verse BETWEEN __low AND __high").drop("__low", "__high")


def verse_counts(ranges: DataFrame, verses: DataFrame) -> DataFrame:
    """``ranges`` that hold a verse, with n, how many of ``verses`` (book, chapter, verse) they hold, and the first and last of these as
    struct(chapter, verse). Ranges that are equal meet the verses once, so work grows with the ranges that differ."""
    span = ["book", "chapter", "verse", "to_chapter", "to_verse"]
    asked = ranges.where("book IS NOT NULL").select(*span).distinct()
    at = F.struct(F.col("at_chapter").alias("chapter"), F.col("at_verse").alias("verse"))
    held = verses_in(asked, verses).groupBy(*span).agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
    return ranges.join(held, span)
