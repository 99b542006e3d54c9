"""Language-model scores from a Katz backoff model of words, trained on part of the documents.

Words are counted by block, summed by ranges of their fingerprint into the unigram table, and each block hears
the counts and numbers of its own words (numbers go up as counts go down, so most are short). Pairs of neighbours
are counted likewise, by the first word's number, into the bigram table; a block hears the count of each of its pairs and, for each first word, what its discounted mass
and backoff weight follow from. The pairs of a frequent first word are dealt by their second word to as many buckets as its
occurrences ask for; what follows from all of them is added up over these buckets and joined to the blocks that have the word.
Every document is then scored where its text is.

p(w | v) = d(c) c / C(v) for a pair seen c times, else weight(v) p(w); d is the Good-Turing discount, and
weight(v) = (1 - the discounted mass of v) / (1 - the unigram mass of the words seen after v), so that the
probabilities after any v sum to one. p(w) is discounted too; what that frees is the chance of an unknown word.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import blocks
from quire.llm.blocks import by_bucket, by_range, with_answers, write_blocks
from quire.llm.scratch import bounded, cut, text_mb
from quire.llm.words import Batch, parts

#: Counts above this aren't discounted.
KATZ_K = 5
END = np.uint64(0x454E44454E44454E)
#: The number of what stands before a text's first token.
START = 0
#: Spreads numbers of second words over the buckets of a first.
MIX = np.uint64(0x9E3779B97F4A7C15)
BLOCK_MB = 6
#: Bytes of text whose words, and whose pairs, meet in one bucket.
WORD_BUCKET_MB, PAIR_BUCKET_MB = 40, 10
#: Pairs of a bucket that are summed at once.
RANGE = 300_000
#: Occurrences of a first word (in all documents) for each bucket that its pairs are dealt to.
SPREAD = 300_000


def pack(numbers: np.ndarray) -> bytes:
    """``blocks.pack``, compressed by zstd after its size: most numbers here are small, and the codec of shuffles finds repeats only."""
    raw = blocks.pack(numbers)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    return blocks.unpack(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True))


def good_turing(counts: list[int]) -> np.ndarray:
    """Discounts d[0..KATZ_K+1] from how many things were seen 1, 2, ... KATZ_K + 1 times.

    d[r] = (r*/r - m) / (1 - m) with r* = (r + 1) n[r+1] / n[r] and m = (KATZ_K + 1) n[KATZ_K+1] / n[1]; where that
    is not above 0 and below 1 (counts too few to tell), d[r] = (r - 1/2) / r. d[KATZ_K + 1] = 1 stands for all above.
    """
    n = [0, *counts]
    d = np.ones(KATZ_K + 2)
    m = (KATZ_K + 1) * n[KATZ_K + 1] / n[1] if n[1] else 1.0
    for r in range(1, KATZ_K + 1):
        d[r] = ((r + 1) * n[r + 1] / n[r] / r - m) / (1 - m) if n[r] and m != 1 else 0.0
        if not 0 < d[r] < 1:
            d[r] = (r - 0.5) / r
    return d


class Unigrams:
    """Probabilities of words by their training count."""

    def __init__(self, total: int, distinct: int, counts: list[int]) -> None:
        self.total, self.distinct, self.d = total, distinct, good_turing(counts)
        freed = sum((1 - self.d[r]) * r * n for r, n in enumerate(counts[:KATZ_K], 1))
        # where no count is small enough to discount, one more token is set aside
        self.size = total if freed else total + 1
        self.unknown = (freed if freed else 1) / self.size

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.d[np.minimum(c, KATZ_K + 1)] * c / self.size, self.unknown)


def backoff(total: np.ndarray, small: np.ndarray, seen_p: np.ndarray, d: np.ndarray, unknown: float) -> tuple[np.ndarray, np.ndarray]:
    """(size, weight) of first words: what a pair's discounted count is divided by, and the backoff weight.

    total: pairs seen after the word; small[r-1]: of them, distinct ones seen r times; seen_p: their unigram mass.
    """
    r = np.arange(1, KATZ_K + 1)
    freed = (small * ((1 - d[1 : KATZ_K + 1]) * r)[:, None]).sum(axis=0)
    size = np.where(freed > 0, total, total + 1)
    left = np.where(freed > 0, freed, 1) / np.maximum(size, 1)
    weight = np.where(total > 0, left / np.maximum(1 - seen_p, unknown), 1.0)
    return size, weight


class Tokens:
    """The tokens of a block's rows: words, then an end for each row."""

    def __init__(self, rows: pd.DataFrame, fold: tuple[int, int]) -> None:
        texts = rows["text"].tolist()
        hashes, counts = [], []
        for i, j in parts(texts):
            b = Batch(texts[i:j], lower=True)
            hashes.append(b.hashes)
            counts.append(b.counts())
        n = np.concatenate(counts) + 1
        self.ends = np.cumsum(n)
        self.words = np.empty(self.ends[-1], np.uint64)
        last = np.zeros(len(self.words), bool)
        last[self.ends - 1] = True
        self.words[last] = END
        self.words[~last] = np.concatenate(hashes)
        self.row = np.repeat(np.arange(len(n), dtype=np.int32), n)
        self.n = n
        self.held_out = np.array([zlib.crc32((i or "").encode()) % fold[0] == fold[1] for i in rows["id"]])
        self.trained = (~self.held_out).astype(np.float64)
        self.vocabulary, ids = np.unique(self.words, return_inverse=True)
        self.ids = ids.astype(np.int32)
        del self.words

    def pairs(self, numbers: np.ndarray, pieces: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, first, second, hot, place): distinct pairs, sorted by bucket, first and second (as numbers), whether their
        first word is dealt to several buckets, and each token's pair. first holds numbers, second places in the vocabulary.

        pieces: how many buckets each word's pairs go to when it is first; those of START are the end's, as often seen.
        """
        v = len(self.vocabulary)
        pieces = np.append(pieces, pieces[np.searchsorted(self.vocabulary, END)])
        firsts, rank = np.append(numbers, np.uint64(START)), np.empty(v + 1, np.int64)
        by_bucket, by_number = np.lexsort((firsts, firsts % np.uint64(buckets))), np.argsort(numbers)
        rank[by_bucket] = np.arange(v + 1)
        pair = rank[np.concatenate(([v], self.ids[:-1]))]
        pair[self.ends[:-1]] = rank[v]
        rank = rank[:v]
        rank[by_number] = np.arange(v)
        pair *= v
        pair += rank[self.ids]
        pair, place = np.unique(pair, return_inverse=True)
        at, second = by_bucket[pair // v], by_number[pair % v]
        first, pieces = firsts[at], np.minimum(pieces[at], np.uint64(buckets))
        bucket, hot = first % np.uint64(buckets), pieces > 1
        if not hot.any():
            return bucket, first, second, hot, place.astype(np.int32)
        bucket[hot] = (bucket[hot] + (numbers[second[hot]] * MIX >> np.uint64(32)) % pieces[hot]) % np.uint64(buckets)
        order, rank = np.lexsort((first, bucket)), np.empty(len(first), np.int32)
        rank[order] = np.arange(len(first), dtype=np.int32)
        return bucket[order], first[order], second[order], hot[order], rank[place]

    def sums(self, place: np.ndarray, n: int) -> np.ndarray:
        """Training occurrences of each of n things."""
        return np.bincount(place, self.trained[self.row], n).astype(np.uint64)


WORDS_ASKED = "bucket int, block int, keys binary, counts binary, held_out binary"
PAIRS_ASKED = "bucket int, block int, firsts binary, runs binary, seconds binary, counts binary, word_counts binary, hot binary"
#: block -1 is the table itself. Pass 3 is about first words dealt to several buckets: in block -2 what one of these adds to
#: total, distinct (pairs), seen and mass of ``first``, else that a block has that word, and then the sums.
HEARD = "pass int, bucket int, block int, a binary, b binary, c binary, d binary, total long, distinct long, seen array<long>, first long, mass double"


def _heard_row(number, bucket, block, a=b"", b=b"", c=b"", d=b"", counts=None, first=-1, mass=0.0):
    total, distinct, seen = (0, 0, [0] * (KATZ_K + 1))
    if counts is not None:
        total, distinct, seen = int(counts.sum()), int((counts > 0).sum()), np.bincount(np.minimum(counts, KATZ_K + 2).astype(np.int64), minlength=KATZ_K + 3)[1:-1].tolist()
    return number, bucket, block, a, b, c, d, total, distinct, seen, first, mass


_HEARD_NAMES = [x.split()[0] for x in HEARD.replace("array<long>", "x").split(", ")]


def _sum_words(pdf: pd.DataFrame, buckets: int, spread: int) -> pd.DataFrame:
    """One bucket of words: its part of the unigram table, and counts and numbers for each block that asked, with how many
    buckets more than one each word's pairs go to (empty where none does)."""
    keys, counts = [unpack(k) for k in pdf["keys"]], [unpack(c) for c in pdf["counts"]]
    u, back = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(back, np.concatenate(counts).astype(np.float64), len(u)).astype(np.uint64)
    bucket = int(pdf["bucket"].iloc[0])
    number = np.empty(len(u), np.uint64)
    number[np.argsort(-n.astype(np.int64), kind="stable")] = np.arange(len(u), dtype=np.uint64) * np.uint64(buckets) + np.uint64(bucket + 1)
    seen = n > 0
    more = (n + np.bincount(back, np.concatenate([unpack(h) for h in pdf["held_out"]]).astype(np.float64), len(u)).astype(np.uint64) - np.uint64(1)) // np.uint64(spread)
    out = [_heard_row(1, bucket, -1, pack(u[seen]), pack(n[seen]), pack(number[seen]), counts=n)]
    ends = np.cumsum([len(k) for k in keys])
    for block, e, k in zip(pdf["block"], ends, keys, strict=True):
        at = back[e - len(k) : e]
        hot = at[more[at] > 0]
        out.append(_heard_row(1, bucket, block, pack(n[at]), pack(number[at]), pack(more[at]) if len(hot) else b""))
        out += [_heard_row(3, bucket, block, first=f) for f in np.where(u[hot] == END, np.uint64(START), number[hot]).tolist()]
    return pd.DataFrame(out, columns=_HEARD_NAMES)


class Asked:
    """The pairs that a block asks about in a bucket, in small types."""

    def __init__(self, row) -> None:
        self.block, self.firsts = row.block, unpack(row.firsts)
        self.ends = np.concatenate(([0], np.cumsum(unpack(row.runs).astype(np.int64))))
        self.seconds, self.counts, self.word_counts = unpack(row.seconds), unpack(row.counts).astype(np.uint32), unpack(row.word_counts)
        self.hot = unpack(row.hot) if row.hot else np.zeros(0, np.uint64)
        self.totals: list[np.ndarray] = []
        self.facts: list[np.ndarray] = []
        self.mass: list[np.ndarray] = []

    def part(self, low: np.uint64, high: np.uint64) -> tuple[np.ndarray, ...]:
        """(first, second, count, count of the second word) of the pairs whose first word is in a range; the firsts and their pairs."""
        i, j = np.searchsorted(self.firsts, low), np.searchsorted(self.firsts, high, "right")
        x, y = self.ends[i], self.ends[j]
        return np.repeat(self.firsts[i:j], np.diff(self.ends[i : j + 1])), self.seconds[x:y], self.counts[x:y], self.word_counts[x:y], self.firsts[i:j], np.diff(self.ends[i : j + 1])


def followers(totals: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """How many of a block's own pairs of each first word were seen in training. Where these are all that were, the block can
    sum their unigram mass itself, and isn't sent it."""
    return np.add.reduceat((totals > 0).astype(np.uint64), np.cumsum(runs) - runs) if len(runs) else np.zeros(0, np.uint64)


def _sum_pairs(pdf: pd.DataFrame, unigrams: Unigrams) -> pd.DataFrame:
    """One bucket of first words: its part of the bigram table, what each block that asked needs, and what the bucket adds to
    first words that are dealt to several.

    The bucket's first words are worked through in ranges with about ``RANGE`` pairs, so that arrays stay small.
    """
    bucket = int(pdf["bucket"].iloc[0])
    asked = [Asked(r) for r in pdf.sort_values("block").itertuples(index=False)]
    del pdf
    hot = np.unique(np.concatenate([a.hot for a in asked]))
    firsts, runs = np.concatenate([a.firsts for a in asked]), np.concatenate([np.diff(a.ends) for a in asked])
    order = np.argsort(firsts, kind="stable")
    firsts, upto = firsts[order], np.cumsum(runs[order])
    lasts = np.unique(firsts[np.minimum(np.searchsorted(upto, np.arange(RANGE, upto[-1] + RANGE, RANGE)), len(firsts) - 1)])
    del runs, order, upto
    low, out = np.uint64(0), []
    for last in lasts:
        out += _sum_range(bucket, asked, low, last, unigrams, hot)
        low = last + np.uint64(1)
    for a in asked:
        facts = pack(np.concatenate(a.facts, axis=1).ravel())
        out.append(_heard_row(2, bucket, a.block, pack(np.concatenate(a.totals)), facts, np.concatenate(a.mass).tobytes()))
    return pd.DataFrame(out, columns=_HEARD_NAMES)


def _sum_range(bucket: int, asked: list[Asked], low: np.uint64, high: np.uint64, unigrams: Unigrams, hot: np.ndarray) -> list[tuple]:
    """Adds the sums over a range of first words to those who asked; gives the range's row of the bigram table, and one for each hot word."""
    parts_ = [a.part(low, high) for a in asked]
    first, second, count, word = (np.concatenate([p[k] for p in parts_]) for k in range(4))
    if not len(first):
        for a in asked:
            a.totals.append(np.zeros(0, np.uint64))
            a.facts.append(np.zeros((KATZ_K + 2, 0), np.uint64))
            a.mass.append(np.zeros(0))
        return []
    order = np.lexsort((second, first))
    f, s = first[order], second[order]
    new_first = np.concatenate(([True], f[1:] != f[:-1]))
    new_pair = new_first | np.concatenate(([True], s[1:] != s[:-1]))
    at_pair, at_first = np.flatnonzero(new_pair), np.flatnonzero(new_first)
    total = np.add.reduceat(count[order].astype(np.uint64), at_pair)
    pair_of = np.empty(len(order), np.int64)
    pair_of[order] = np.cumsum(new_pair) - 1
    # sums over the pairs of each first word
    starts = np.searchsorted(at_pair, at_first)
    p = np.where(total > 0, unigrams.p(word[order][at_pair].astype(np.int64)), 0.0)
    mass, keep = np.add.reduceat(p, starts), total > 0
    lengths = np.add.reduceat(keep.astype(np.uint64), starts)
    facts = np.stack([lengths, np.add.reduceat(total, starts), *[np.add.reduceat((total == r).astype(np.uint64), starts) for r in range(1, KATZ_K + 1)]])
    u, n = f[at_first], 0
    for a, part in zip(asked, parts_, strict=True):
        a.totals.append(total[pair_of[n : n + len(part[0])]])
        n += len(part[0])
        i = np.searchsorted(u, part[4])
        a.facts.append(facts[:, i])
        a.mass.append(mass[i][lengths[i] > followers(a.totals[-1], part[5])])
    out = [_heard_row(2, bucket, -1, pack(u), pack(lengths), pack(s[at_pair][keep]), pack(total[keep]), total)]
    ends = np.append(starts[1:], len(total))
    return out + [_heard_row(3, bucket, -2, counts=total[starts[i] : ends[i]], first=int(u[i]), mass=float(mass[i])) for i in np.flatnonzero(np.isin(u, hot))]


def _totals(heard: DataFrame) -> tuple[int, int, list[int]]:
    """(total, distinct, how many were seen 1, 2, ... times): sums over the buckets."""
    seen = [F.sum(F.get("seen", i)) for i in range(KATZ_K + 1)]
    row = heard.where("block = -1").agg(F.sum("total"), F.sum("distinct"), *seen).first()
    return row[0] or 0, row[1] or 0, [x or 0 for x in row[2:]]


class Scored:
    """``scores``: a row for each document; ``unigrams`` and ``bigrams``: the stored tables, a row for each bucket."""

    def __init__(self, scores: DataFrame, unigrams: DataFrame, bigrams: DataFrame) -> None:
        self.scores, self.unigrams, self.bigrams = scores, unigrams, bigrams


def _hot_facts(heard: DataFrame, pairs: DataFrame) -> DataFrame:
    """A row for each block and first word of it that is dealt to several buckets, with the sums over these."""
    sums = [F.sum(F.get("seen", i)) for i in range(KATZ_K + 1)]
    facts = pairs.where("block = -2").groupBy("first").agg(F.sum("total").alias("total"), F.sum("distinct").alias("distinct"), F.array(*sums).alias("seen"), F.sum("mass").alias("mass"))
    asking = heard.where("pass = 3").drop("total", "distinct", "seen", "mass")
    return asking.join(bounded(cut(facts, "katz-hot")), "first").select(_HEARD_NAMES)


def train_and_score(docs: DataFrame, key: str = "doc_id", text: str = "text", fold: tuple[int, int] = (7, 2), spread: int = SPREAD) -> Scored:
    """Trains on documents whose crc32(id as text) mod fold[0] isn't fold[1], and scores every document.

    scores has (key, held_out, n_tokens, n_known, train_tokens, base_score, score): base_score sums
    log10((c + 1) / (N + V + 1)) over the tokens, score sums the model's log10 probabilities. Texts are lower-cased
    (A-Z) and cut at ASCII white space; each ends with an end token, so null and empty texts have that one alone.
    A null id reads as an empty text. Rows with the same id are scored each for itself. Without training rows every
    token is unknown, with probability one. spread: occurrences of a first word for each bucket of its pairs.
    """
    total_mb = text_mb(docs, text)
    word_buckets, pair_buckets = max(4, math.ceil(total_mb / WORD_BUCKET_MB)), max(8, math.ceil(total_mb / PAIR_BUCKET_MB))
    table = write_blocks(docs, key, text, total_mb, BLOCK_MB)

    def ask_words(rows: pd.DataFrame, _) -> pd.DataFrame:
        t = Tokens(rows, fold)
        n = t.sums(t.ids, len(t.vocabulary))
        held_out = np.bincount(t.ids, minlength=len(n)).astype(np.uint64) - n
        block = rows["block"].iloc[0]
        out = [(b, block, pack(t.vocabulary[i:j]), pack(n[i:j]), pack(held_out[i:j])) for b, i, j in by_range(t.vocabulary, word_buckets)]
        return pd.DataFrame(out, columns=["bucket", "block", "keys", "counts", "held_out"])

    heard = cut(by_bucket(with_answers(table, None, ask_words, WORDS_ASKED), lambda pdf: _sum_words(pdf, word_buckets, spread), HEARD), "katz-words")
    unigrams = Unigrams(*_totals(heard))

    def own_words(answers: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts and numbers of a block's vocabulary, and to how many buckets each word's pairs go."""
        mine = answers[answers["pass"] == 1].sort_values("bucket")
        counts = [unpack(x) for x in mine["a"]]
        more = [unpack(x) if x else np.zeros(len(n), np.uint64) for x, n in zip(mine["c"], counts, strict=True)]
        return np.concatenate(counts), np.concatenate([unpack(x) for x in mine["b"]]), np.concatenate(more) + np.uint64(1)

    def ask_pairs(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        t = Tokens(rows, fold)
        words, numbers, pieces = own_words(answers)
        bucket, first, second, hot, place = t.pairs(numbers, pieces, pair_buckets)
        n = t.sums(place, len(first))
        out = []
        for b, i, j, firsts, runs in _runs(bucket, first):
            w, several = second[i:j], np.unique(first[i:j][hot[i:j]])
            out.append((b, rows["block"].iloc[0], pack(firsts), pack(runs), pack(numbers[w]), pack(n[i:j]), pack(words[w]), pack(several) if len(several) else b""))
        return pd.DataFrame(out, columns=["bucket", "block", "firsts", "runs", "seconds", "counts", "word_counts", "hot"])

    asked = with_answers(table, heard.where("block >= 0 AND pass = 1"), ask_pairs, PAIRS_ASKED)
    pairs = cut(by_bucket(asked, lambda pdf: _sum_pairs(pdf, unigrams), HEARD), "katz-pairs")
    d = good_turing(_totals(pairs)[2])

    def score(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        t = Tokens(rows, fold)
        words, numbers, pieces = own_words(answers)
        words = words.astype(np.int64)
        c = words[t.ids]
        bucket, first, second, _, place = t.pairs(numbers, pieces, pair_buckets)
        logs = np.empty(len(first))
        mine = answers[answers["pass"] == 2].set_index("bucket")
        summed = answers[answers["pass"] == 3].sort_values("first")
        hot, hot_mass = summed["first"].to_numpy(np.uint64), summed["mass"].to_numpy(np.float64)
        hot_facts = np.array([[n, x, *seen[:KATZ_K]] for n, x, seen in zip(summed["distinct"], summed["total"], summed["seen"], strict=True)], np.uint64).reshape(-1, KATZ_K + 2).T
        for b, i, j, firsts, runs in _runs(bucket, first):
            got = mine.loc[b]
            facts = unpack(got["b"]).reshape(KATZ_K + 2, -1)
            n, runs = unpack(got["a"]).astype(np.int64), runs.astype(np.int64)
            word_p = unigrams.p(words[second[i:j]])
            mass = np.add.reduceat(np.where(n > 0, word_p, 0.0), np.cumsum(runs) - runs)
            mass[facts[0] > followers(n, runs)] = np.frombuffer(got["c"])
            if (several := np.isin(firsts, hot)).any():
                at = np.searchsorted(hot, firsts[several])
                facts[:, several], mass[several] = hot_facts[:, at], hot_mass[at]
            size, weight = backoff(facts[1].astype(np.float64), facts[2:].astype(np.float64), mass, d, unigrams.unknown)
            seen = d[np.minimum(n, KATZ_K + 1)] * n / np.maximum(np.repeat(size, runs), 1)
            logs[i:j] = np.log10(np.where(n > 0, seen, np.repeat(weight, runs) * word_p))
        base = np.log10((c + 1) / (unigrams.total + unigrams.distinct + 1))
        starts = t.ends - t.n
        return pd.DataFrame(
            {
                "id": rows["id"], "held_out": t.held_out, "n_tokens": t.n, "n_known": np.add.reduceat((c > 0).astype(np.int64), starts),
                "train_tokens": np.int64(unigrams.total), "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(logs[place], starts),
            }
        )

    kind = dict(docs.dtypes)[key]
    answers = heard.where("block >= 0 AND pass = 1").unionByName(pairs.where("block >= 0")).unionByName(_hot_facts(heard, pairs))
    schema = "id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scores = with_answers(table, answers, score, schema).select(F.col("id").cast(kind).alias(key), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    named = lambda df, *names: df.where("block = -1").select("bucket", *[F.col(c).alias(n) for c, n in zip("abcd", names, strict=False)])
    return Scored(scores, named(heard, "words", "counts", "numbers"), named(pairs, "firsts", "followers", "seconds", "counts"))


def _runs(bucket: np.ndarray, first: np.ndarray):
    """(bucket, from, to, first words, pairs of each) over the sorted distinct pairs of a block."""
    at = np.flatnonzero(np.concatenate(([True], (first[1:] != first[:-1]) | (bucket[1:] != bucket[:-1]))))
    ends = np.append(at[1:], len(first))
    names, bucket = first[at], bucket[at]
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(bucket[i]), at[i], ends[j - 1], names[i:j], (ends - at)[i:j].astype(np.uint64)
