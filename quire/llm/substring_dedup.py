"""Removal of repeated byte strings by suffix sorting with a difference cover, one bucket at a time.

A suffix array of the corpus would show every string of 200 bytes that occurs twice as neighbours that share
200 bytes. Only that tie matters here, so suffixes are compared to that depth, in the order of fingerprints of their
bytes, and those that can't tie are never written:

1. Cover sample. Positions whose offset modulo 73 is a power of two form a difference cover: any two offsets
   have a common shift below 73 that takes both into the sample. The sample suffixes are sorted by their first
   127 bytes, a bucket (a range of fingerprints) at a time, and those that tie get their rank in that order. If two
   strings of 200 bytes are equal, so are two sample suffixes that begin within their first 73 bytes; so a suffix
   without a rank in reach is settled as untied.
2. Long ties. A sample suffix and those 73 and 146 bytes behind it are in the sample together, so the triple of their
   ranks stands for 273 bytes; triples are sorted in buckets. Those that tie mark these bytes, and the 73 suffixes
   after each are tied with those after the first of its equals, for which they need no sorting.
3. Bucketed sort. What remains, suffixes near the ends of repeats and one of each long tie, is sorted to the full
   depth in buckets of a bounded size.

Fingerprints have 64 bits: n suffixes at full depth show a false tie with odds of about n**2 / 2**65.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.blocks import ASKED, answer, ask, hear, with_answers, write_blocks
from quire.llm.scratch import cut, text_mb
from quire.llm.words import mix, powers, prefix_hash

LENGTH = 200
PERIOD = 73
#: The powers of two modulo 73, a perfect difference set.
COVER = sorted({pow(2, k, PERIOD) for k in range(9)})
BLOCK_MB = 4
#: Bytes of text whose keys meet in one bucket.
BUCKET_MB = 12


class Block:
    """The texts of a block as bytes, with fingerprints of any substring."""

    def __init__(self, texts, length: int) -> None:
        self.length, self.short = length, length - PERIOD
        self.raw = [b"" if t is None else t.encode("utf-8") for t in texts]
        lens = np.fromiter(map(len, self.raw), np.int64, len(self.raw))
        self.bounds = np.concatenate(([0], np.cumsum(lens)))
        data = np.frombuffer(b"".join(self.raw), np.uint8)
        self.n = len(data)
        power, self.inverse = powers(self.n)
        self.h = prefix_hash(data, power)
        self.offset = np.arange(self.n) - np.repeat(self.bounds[:-1], lens)
        self.room = np.repeat(self.bounds[1:], lens) - np.arange(self.n)

    def names(self, at: np.ndarray, size: int) -> np.ndarray:
        return mix((self.h[at + size] - self.h[at]) * self.inverse[at])

    def sample(self) -> np.ndarray:
        """Positions of the cover sample with room for their depth."""
        member = np.zeros(PERIOD, bool)
        member[COVER] = True
        return np.flatnonzero(member[self.offset % PERIOD] & (self.room >= self.short))

    def spread(self, at: np.ndarray, length: int) -> np.ndarray:
        """Places less than ``length`` after distinct positions."""
        change = np.zeros(self.n + 1, np.int32)
        change[at] += 1
        change[at + length] -= 1
        return np.cumsum(change[: self.n]) > 0

    def tied(self, sample: np.ndarray, settled: np.ndarray) -> np.ndarray:
        """Suffixes with a tied sample suffix among their first PERIOD and not settled."""
        near = np.zeros(self.n + PERIOD + 1, np.int64)
        near[sample + 1] = 1
        near = np.cumsum(near)
        at = np.flatnonzero((self.room >= self.length) & ~settled)
        return at[near[at + PERIOD] > near[at]]


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, n_bytes, spans array<struct<start, end>>, kept binary) for each row of ``docs``.

    A byte goes if it lies in a string of ``length`` bytes that also starts anywhere else, in the same text or
    another; overlaps count, and strings are judged on the input. spans are the maximal removed runs as byte offsets,
    kept is what is left. Null texts are empty. Rows with the same id are separate texts. ``length`` is over 73.
    """
    if length <= PERIOD:
        raise ValueError(f"length must be over {PERIOD}")
    total = text_mb(docs, text)
    buckets = max(8, math.ceil(total / BUCKET_MB))
    table = write_blocks(docs, key, text, total, BLOCK_MB)

    def block(rows: pd.DataFrame) -> tuple[pd.DataFrame, Block]:
        rows = rows.sort_values(["id", "text"])  # the same order in each pass
        return rows, Block(rows["text"], length)

    def asked(rows: pd.DataFrame, keys: np.ndarray) -> pd.DataFrame:
        return ask(rows["block"].iloc[0], keys, buckets)

    def sample_ties(b: Block, answers: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tied sample suffixes, those of them that may begin a long tie, and the names of these ties."""
        at = b.sample()
        rank = np.zeros(b.n + 1, np.uint64)
        rank[at] = hear(answers, 1, b.names(at, b.short), buckets)[0]
        at = at[rank[at] > 0]
        long = at[b.room[at] >= length + PERIOD]
        triple = [rank[long + k * PERIOD] for k in range(3)]
        ranked = (triple[1] > 0) & (triple[2] > 0)
        long, (first, second, third) = long[ranked], (x[ranked] for x in triple)
        names = mix(mix(mix(first) + second) + third)
        # where 127 bytes (for other lengths: fewer) don't reach the next of the three, what lies between tells as well
        return at, long, names if b.short >= PERIOD else mix(names + b.names(long, length + PERIOD))

    def open_suffixes(b: Block, answers: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes left to be sorted, and bytes in long ties."""
        sample, long, names = sample_ties(b, answers)
        rank, lead = hear(answers, 2, names, buckets)
        settled = b.spread(long[(rank > 0) & ~lead], PERIOD + 1)
        return b.tied(sample, settled), b.spread(long[rank > 0], length + PERIOD)

    def first(rows: pd.DataFrame, _) -> pd.DataFrame:
        rows, b = block(rows)
        return asked(rows, b.names(b.sample(), b.short))

    def second(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows, b = block(rows)
        return asked(rows, sample_ties(b, answers)[2])

    def third(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows, b = block(rows)
        return asked(rows, b.names(open_suffixes(b, answers)[0], length))

    def final(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows, b = block(rows)
        at, marked = open_suffixes(b, answers)
        marked |= b.spread(at[hear(answers, 3, b.names(at, length), buckets)[0] > 0], length)
        spans, kept = [], []
        for i, raw in enumerate(b.raw):
            m = marked[b.bounds[i] : b.bounds[i + 1]]
            edge = np.flatnonzero(np.diff(np.concatenate(([False], m, [False])).astype(np.int8))).reshape(-1, 2)
            spans.append([{"start": int(x), "end": int(y)} for x, y in edge])
            kept.append(np.frombuffer(raw, np.uint8)[~m].tobytes() if len(edge) else raw)
        return pd.DataFrame({"id": rows["id"], "n_bytes": np.diff(b.bounds), "spans": spans, "kept": kept})

    answers = None
    for number, step in enumerate((first, second, third), 1):
        new = cut(answer(with_answers(table, answers, step, ASKED), number), "suffix-ties")
        answers = new if answers is None else cut(answers.unionByName(new), "suffix-ties")
    kind = dict(docs.dtypes)[key]
    out = with_answers(table, answers, final, "id string, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
    return out.select(F.col("id").cast(kind).alias(key), "n_bytes", "spans", "kept")
