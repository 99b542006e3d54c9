"""Quality rules: fixed limits on repetition and length, then boosted trees over document statistics.

The statistics are taken in one vectorised pass over each batch of texts. The trees are fitted on a bounded
sample of labelled rows (``TRAIN_ROWS``, those with the smallest hash of their id), flattened into node arrays
and applied to every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.boosting import Forest, train
from quire.llm.scratch import cut
from quire.llm.words import Batch, M, mix, parts, tidied, tidy

#: At most so many labelled documents are used to fit the trees.
TRAIN_ROWS = 20_000
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features of the trees, and how the chance of being good may go with each (0: either way).
FEATURES = {
    "log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1,
    "digit_share": 0, "bang_share": -1, "distinct_share": 0, "top_share": -1, "line_words": 0, "stop_share": 0,
}


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeats(hashes: np.ndarray) -> int:
    """Words in windows of WINDOW words that occur twice or more."""
    n = len(hashes) - WINDOW + 1
    if n < 2:
        return 0
    w = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        w = mix(w * M + hashes[k : k + n])
    order = np.argsort(w, kind="stable")
    same = w[order][1:] == w[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    change = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, np.flatnonzero(hit), 1)
    np.add.at(change, np.flatnonzero(hit) + WINDOW, -1)
    return int((np.cumsum(change) > 0).sum())


def _dup_lines(raw: bytes) -> tuple[int, int]:
    """(lines with a word, those of them that equal an earlier line)."""
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines), len(lines) - len(set(lines))


def statistics(texts) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base counts (see ``BASE``) of each text, and its row of features."""
    texts = list(texts)
    got = [_statistics(texts[i:j]) for i, j in parts(texts)] or [_statistics([])]
    return {c: np.concatenate([base[c] for base, _ in got]) for c in BASE}, np.concatenate([x for _, x in got])


def _statistics(texts: list) -> tuple[dict[str, np.ndarray], np.ndarray]:
    b = Batch(texts, lower=False)
    data, n = b.data, b.counts()
    space = (data == 32) | ((data >= 9) & (data <= 13))
    per = lambda flags: _per_text(flags, b.bounds).astype(np.int64)
    head = (data & 0xC0) != 0x80  # the first byte of a code point
    chars = per(head & ~space)
    symbols = per(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)))
    lines = np.array([_dup_lines(t) for t in b.raw], np.int64).reshape(-1, 2)
    ends = list(zip(b.offsets[:-1], b.offsets[1:], strict=True))
    repeats = np.array([_repeats(b.hashes[i:j]) for i, j in ends], np.int64)
    base = {"n_words": n.astype(np.int64), "word_chars": chars, "n_symbols": symbols, "n_dup_lines": lines[:, 1], "n_repeat_words": repeats}
    counted = [np.unique(b.hashes[i:j], return_counts=True)[1] for i, j in ends]
    distinct = np.fromiter(map(len, counted), np.float64, len(counted))
    top = np.array([c.max() if len(c) else 0 for c in counted], np.float64)
    c, w = np.maximum(chars, 1), np.maximum(n, 1)
    upper, digit = per((data >= 65) & (data <= 90)), per((data >= 48) & (data <= 57))
    bang, stop = per((data == 33) | (data == 63)), per((data == 46) | (data == 44))
    x = np.stack([np.log1p(n), chars / w, symbols / c, lines[:, 1] / np.maximum(lines[:, 0], 1), repeats / w, upper / c, digit / c, bang / c, distinct / w, top / w, n / np.maximum(lines[:, 0], 1), stop / c], axis=1)
    return base, x.astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> Forest:
    """Trees that tell quality 1 from 0, from at most ``rows`` labelled documents. Conflicting labels of an id count as 0."""
    known = labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(key).alias("id")).agg(F.min("quality").alias("good"))
    sample = cut(known.orderBy(F.xxhash64("id"), "id").limit(rows), "quality-sample")
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(sample), "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "good": pdf["good"], "x": list(statistics(pdf["text"])[1])})

    # of rows that share an id, that with the least features, so that reruns give the same trees
    got = texts.mapInPandas(tidied(run), "id long, good long, x array<double>").groupBy("id").agg(F.min("good").alias("good"), F.min("x").alias("x")).toPandas().sort_values("id")
    x = np.array(got["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return train(x, got["good"].to_numpy(np.float64), np.array(list(FEATURES.values()), np.float64))


def judge(docs: DataFrame, forest: Forest, key: str = "doc_id", text: str = "text", least: float = 0.1, into: str = "quality") -> DataFrame:
    """``docs`` with a column ``into`` (one of that name is replaced), struct(the counts of BASE, base_failed, probability, kept).

    base_failed: fewer than 20 words, or over 30 % of the words lie in windows of eight words that the text repeats.
    kept: not base_failed, and the trees give at least ``least`` for good. Null and empty texts have no words and fail.
    """
    fields = ", ".join(f"{c}: long" for c in BASE)
    kind = f"struct<{fields}, base_failed: boolean, probability: double, kept: boolean>"

    @F.pandas_udf(kind)
    def measure(texts: pd.Series) -> pd.DataFrame:
        base, x = statistics(texts)
        failed = (base["n_words"] < 20) | (100 * base["n_repeat_words"] > 30 * base["n_words"])
        p = 1 / (1 + np.exp(-forest.score(x)))
        tidy()
        return pd.DataFrame(base | {"base_failed": failed, "probability": p, "kept": ~failed & (p >= least)})

    return docs.withColumn(into, measure(F.col(text)))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.1) -> DataFrame:
    """``docs`` without the documents that the rules or the trees reject."""
    rows = judge(docs, fit(docs, labels, key, text), key, text, least, "__quality")
    return rows.where("__quality.kept").select(*docs.columns)
