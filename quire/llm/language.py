"""Language identification: scripts narrow the candidates of each word, a Viterbi path over the words' scores labels spans.

A model holds, for each language of the training rows, the log-probabilities of its hashed character n-grams and which scripts
it is written in. It is fitted on some ``TRAIN_ROWS`` rows of each language, those with the smallest hash of id and text,
whose grams a task counts before they are shuffled. Prediction is one pass without a shuffle.

A word is a run of letters and marks. Its score in a language is the mean, over the orders of its n-grams, of their summed
log-probabilities; languages that aren't written in the word's script are out, if any is. Along a text's words the path pays
``PENALTY`` for each change of language, so that single foreign words and names don't cut a span. Texts of a batch take their
steps together, so a step is one numpy operation over all of them.
"""

from __future__ import annotations

import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.scratch import small_batches
from quire.llm.words import parts, tidied

#: Rows that each language is learned from, about (a bound on the fit, not on what is labelled).
TRAIN_ROWS = 5000
#: Places that the n-grams of a language are hashed to; a language's table takes four bytes for each.
GRAMS = 1 << 16
ORDERS = range(1, 5)
#: What a change of language costs, in natural logarithms of odds.
PENALTY = 8.0
#: A language is written in a script that has this share of its letters, or is the one it uses most.
WRITTEN = 0.02
#: Scores (words times languages) that are worked on at once.
CELLS = 4_000_000

#: First code point of blocks of letters, and the script that is written there.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "syriac"), (0x0750, "arabic"), (0x0780, "thaana"), (0x07C0, "nko"), (0x0800, "samaritan"), (0x0860, "syriac"),
    (0x0870, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x13A0, "cherokee"), (0x1400, "canadian"), (0x1680, "ogham"), (0x16A0, "runic"), (0x1700, "philippine"), (0x1780, "khmer"),
    (0x1800, "mongolian"), (0x18B0, "canadian"), (0x1900, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CD0, "other"),
    (0x1D00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C00, "other"), (0x2C60, "latin"), (0x2C80, "coptic"),
    (0x2D00, "georgian"), (0x2D30, "tifinagh"), (0x2D80, "ethiopic"), (0x2DE0, "cyrillic"), (0x2E00, "other"), (0x2E80, "han"),
    (0x3040, "kana"), (0x3100, "bopomofo"), (0x3130, "hangul"), (0x31A0, "bopomofo"), (0x31C0, "han"), (0x31F0, "kana"),
    (0x3200, "other"), (0x3400, "han"), (0xA000, "yi"), (0xA4D0, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"),
    (0xA720, "latin"), (0xA800, "other"), (0xA8E0, "devanagari"), (0xA900, "other"), (0xA960, "hangul"), (0xA980, "other"),
    (0xAB00, "ethiopic"), (0xAB30, "latin"), (0xAB70, "cherokee"), (0xABC0, "other"), (0xAC00, "hangul"), (0xD800, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"),
    (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF65, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x1B000, "kana"),
    (0x1B170, "other"), (0x1E900, "adlam"), (0x1E960, "other"), (0x20000, "han"), (0x33480, "other"),
)
NAMES = sorted({name for _, name in SCRIPTS})
SPANS = "array<struct<start:long,end:long,lang:string>>"


def script_of(char: str) -> str:
    return SCRIPTS[bisect_right(SCRIPTS, ord(char), key=lambda s: s[0]) - 1][1]


@cache
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: 2 for letters, 1 for marks, else 0; the number of its script; its lower case (where that is one character)."""
    kind = np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)], np.uint8)
    script = np.zeros(sys.maxunicode + 2, np.uint8)
    for (start, name), (end, _) in zip(SCRIPTS, (*SCRIPTS[1:], (sys.maxunicode + 1, "")), strict=True):
        script[start:end] = NAMES.index(name)
    lower = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for c in np.flatnonzero(kind == 2).tolist():
        if len(low := chr(c).lower()) == 1:
            lower[c] = ord(low)
    return kind, script, lower


class Words:
    """The words of several texts: bounds in ``code``, letters, scripts, and hashed n-grams."""

    def __init__(self, texts: list[str | None]) -> None:
        kinds, scripts, lower = _characters()
        texts = [t or "" for t in texts]
        # a space around each text, so that grams can look one place back and words end at texts
        code = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = kinds[code]
        self.base = np.concatenate(([1], 1 + np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))))
        edge = np.diff((kind > 0).astype(np.int8), prepend=np.int8(0))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        letters = np.concatenate(([0], np.cumsum(kind == 2)))
        n = letters[end] - letters[start]
        some = n > 0
        self.start, self.end, self.letters = start[some], end[some], n[some]
        self.offsets = np.searchsorted(self.start, self.base)
        self.kind, self.scripts, self.code = kind, scripts[code], lower[code]
        # the script of a word is that of its first letter
        first = np.flatnonzero(kind == 2)
        self.script = self.scripts[first[np.searchsorted(first, self.start)]] if len(first) else np.zeros(0, np.uint8)

    def grams(self) -> Iterator[np.ndarray]:
        """Hashes of the n-grams of each order, one at each character of a word and one at what follows it (that sees the end),
        each of the ``order`` characters up to there, or fewer at a word's start, where they end with what stands before it."""
        inside = self.kind > 0
        code = np.where(inside, self.code, np.uint32(32)).astype(np.uint64)
        n = self.end - self.start + 1
        first = self.first()
        places = np.repeat(self.start - first, n) + np.arange(n.sum())
        h, more = np.zeros(len(code), np.uint64), np.ones(len(code), bool)
        for k in range(len(ORDERS)):
            h = (h ^ np.where(more, np.roll(code, k), np.uint64(0))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            if k:
                more &= np.roll(inside, k)
            yield (((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)) % np.uint64(GRAMS)).astype(np.int32)[places]

    def first(self) -> np.ndarray:
        """Where each word's grams begin among those of one order."""
        n = self.end - self.start + 1
        return np.cumsum(n) - n


class Model:
    """Languages in ascending order, with the log-probabilities of their n-grams and their scripts."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray) -> None:
        """counts: (languages, orders, grams) of n-grams; scripts: (languages, scripts) of letters."""
        self.langs = langs
        total = counts.sum(axis=2, keepdims=True)
        # additive smoothing; the mean over orders keeps overlapping grams from counting several times
        self.logs = (np.log((counts + 0.5) / (total + 0.5 * GRAMS)) / len(ORDERS)).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        self.written = ((share >= WRITTEN) | (share == share.max(axis=1, keepdims=True, initial=0)) & (share > 0)).T

    def scores(self, words: Words) -> np.ndarray:
        """(words, languages): log-probabilities; -inf where a script rules a language out."""
        out = np.zeros((len(words.start), len(self.langs)), np.float32)
        if len(out):
            first = words.first()
            for i, hashes in enumerate(words.grams()):
                for lang in range(len(self.langs)):
                    out[:, lang] += np.add.reduceat(self.logs[lang, i][hashes], first)
            fits = self.written[words.script]
            out[~fits & fits.any(axis=1)[:, None]] = -np.inf
        return out


def viterbi(scores: np.ndarray, offsets: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The language of each word: for each text (words offsets[i] to offsets[i + 1]) the path of the highest sum of scores less
    ``penalty`` for each change. Ties go to staying, then to the lower number. A step works on all texts that are long enough."""
    n, langs = np.diff(offsets), scores.shape[1]
    order = np.argsort(-n, kind="stable")
    start, n = offsets[:-1][order], n[order]
    out = np.zeros(len(scores), np.int16)
    if not len(scores) or langs == 1:
        return out
    active = np.searchsorted(-n, -np.arange(n[0]), "left")  # texts with more than t words
    change, source = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int16)
    best = scores[start[: active[0]]].astype(np.float64)
    last = np.zeros(len(n), np.int16)
    for t in range(1, len(active)):
        here = start[: active[t]] + t
        if active[t] < active[t - 1]:
            last[active[t] : active[t - 1]] = best[active[t] :].argmax(axis=1)
            best = best[: active[t]]
        top = best.argmax(axis=1)
        moved = best[np.arange(len(top)), top][:, None] - penalty
        source[here], change[here] = top, best < moved
        best = np.maximum(best, moved) + scores[here]
    last[: active[-1]] = best.argmax(axis=1)
    now = np.zeros(0, np.int16)
    for t in range(len(active) - 1, -1, -1):
        now = np.concatenate((now, last[len(now) : active[t]]))
        here = start[: active[t]] + t
        out[here] = now
        now = np.where(change[here, now], source[here], now)
    return out


def label(texts: list[str | None], model: Model) -> Iterator[tuple[list[tuple[int, int, str]], np.ndarray]]:
    """For each text its spans (start, end, lang) in characters, and the letters in each of the model's languages."""
    some, cells = [], 0
    for i, j in parts(texts):
        words = Words(texts[i:j])
        some.append((model.scores(words), words.offsets, words.start, words.end, words.letters, words.base))
        cells += some[-1][0].size
        if cells >= CELLS or j == len(texts):
            yield from _label(some, model)
            some, cells = [], 0


def _label(some: list[tuple[np.ndarray, ...]], model: Model) -> Iterator[tuple[list[tuple[int, int, str]], np.ndarray]]:
    sizes = np.concatenate([np.diff(p[1]) for p in some])
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    start, end, letters = (np.concatenate([p[k] for p in some]) for k in (2, 3, 4))
    base = np.concatenate([p[5][:-1] for p in some])
    path = viterbi(np.concatenate([p[0] for p in some]), offsets)
    for a, b, base_ in zip(offsets[:-1], offsets[1:], base, strict=True):
        mine = path[a:b]
        cuts = np.flatnonzero(np.diff(mine, prepend=np.int16(-1)))
        ends = np.append(cuts[1:], b - a) - 1 if b > a else cuts
        starts, stops = start[a + cuts] - base_, end[a + ends] - base_
        spans = [(int(s), int(e), model.langs[g]) for s, e, g in zip(starts, stops, mine[cuts], strict=True)]
        yield spans, np.bincount(mine, letters[a:b], minlength=len(model.langs))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """A model of the languages in ``docs``, a null language aside. Of each language about ``rows`` rows are read, those with the
    smallest hash of id and text; fewer if it has fewer. Tables of 1 MB a language go through the driver: languages are some
    hundreds at most.

    Null texts and texts without letters teach nothing, but their language can still be predicted.
    """
    given = docs.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in given.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    hashed = F.shiftrightunsigned(F.xxhash64("id", "text"), 11) / F.lit(float(1 << 53))
    share = F.create_map(*[F.lit(x) for g in langs for x in (g, min(1.0, rows / sizes[g]))]) if langs else F.lit(None)
    places = len(ORDERS) * GRAMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            texts, given = b.column("text").to_pylist(), b.column("lang").to_pylist()
            for g in set(given):
                mine = [t for t, of in zip(texts, given, strict=True) if of == g]
                for i, j in parts(mine):
                    words = Words(mine[i:j])
                    found = [np.bincount(h, minlength=GRAMS) for h in words.grams()] + [np.bincount(words.scripts[words.kind == 2], minlength=len(NAMES))]
                    seen[g] = seen.get(g, 0) + np.concatenate(found)
        for g, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "place", "n"])

    def table(rows: pa.Table) -> pa.Table:
        """One row for a language: all its counts."""
        flat = np.zeros(places + len(NAMES), np.float32)
        flat[rows.column("place").to_numpy()] = rows.column("n").to_numpy()
        return pa.table({"lang": rows.column("lang").slice(0, 1), "counts": pa.array([flat.tobytes()], pa.binary())})

    flat = np.zeros((len(langs), places + len(NAMES)), np.float32)
    if langs:
        taught = given.where(hashed < F.element_at(share, F.col("lang"))).select("text", "lang")
        summed = taught.mapInArrow(tidied(run), "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))
        with small_batches(docs.sparkSession):
            for r in summed.groupBy("lang").applyInArrow(table, "lang string, counts binary").collect():
                flat[langs.index(r["lang"])] = np.frombuffer(r["counts"], np.float32)
    return Model(langs, flat[:, :places].reshape(len(langs), len(ORDERS), GRAMS), flat[:, places:])


def identify(docs: DataFrame, model: Model, text: str = "text", into: str = "language", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with a struct column ``into``: lang (that most letters are in, of equal ones the first), score (its share of the
    letters, 0 to 1) and spans (start, end, lang) in characters, a span reaching over what stands between its words.

    A text that is null or has no letter has lang ``und``, score 0 and no spans; so has any text if the model knows no
    language. Rows are judged each for itself, so equal texts are judged alike and repeated rows stay. All columns of ``docs``
    are returned, or those in ``keep``; one that has the name ``into`` is replaced. An empty table gives an empty one.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in (docs.columns if keep is None else keep) if c != into]
    kept = [F.col(f"`{c}`") for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])
    arrow = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))])

    def judged(texts: list[str | None]) -> Iterator[dict]:
        model = told.value
        for spans, letters in label(texts, model) if model.langs else (([], np.zeros(1)) for _ in texts):
            total, top = letters.sum(), int(letters.argmax())
            if total:
                yield {"lang": model.langs[top], "score": letters[top] / total, "spans": [{"start": s, "end": e, "lang": g} for s, e, g in spans]}
            else:
                yield {"lang": "und", "score": 0.0, "spans": []}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = b.columns[:-1]  # the last one is the text
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(judged(b.columns[-1].to_pylist())), arrow)], [*keep, into])

    return docs.select(*kept, F.col(text).alias("__text")).mapInArrow(tidied(run), f"{schema + ', ' if keep else ''}`{into}` struct<lang:string,score:double,spans:{SPANS}>")


def held_out(key: str = "doc_id", fold: tuple[int, int] = (4, 2)):
    """Whether a row's id, as text (null: empty), falls into the part that models aren't fitted on."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(fold[0])) == fold[1]
