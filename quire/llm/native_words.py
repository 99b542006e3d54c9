"""Words and shingles as column expressions (no Python on the executors)."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """Words of a text; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once: inside a lambda, a plain expression would be worked out for each item."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def windows(array: Column, size: int, make) -> Column:
    """make(list of size neighbouring items) for each place in the array; an empty array if it is shorter."""

    def over(items: Column) -> Column:
        n = F.size(items) - size
        places = F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: i <= n)
        return F.transform(places, lambda i: make([F.get(items, i + k) for k in range(size)]))

    return let(array, over)
