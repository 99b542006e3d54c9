"""Near-duplicate documents by MinHash, odd sketches and exact confirmation.

Each distinct shingle set is signed once (exact copies are one class, so a text repeated a million
times costs one signature in what follows). MinHash values give band keys; documents that share a band
key are candidates. MinHash samples of 1,024 bins, folded into a parity bitmap (an odd sketch), give a sharp
estimate of high similarities from the population count of an XOR, which decides whose full texts are compared.

Candidates of a bucket are never expanded into rows of all pairs. Every member is compared with the bucket's
smallest id. Members whose component still differs from the leader's then meet the rest of the bucket, in blocks
of a bounded size that hold sketches and sets; each proposes its best links to every component that it has one to, down
to one that chance can't have made. So no link between components is lost. A bucket of members without a common
component costs as many sketch comparisons as it has strays times members; 128 equal MinHash values in groups of four
make such buckets rare among texts that aren't alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.scratch import cut, with_rows_of
from quire.llm.words import Batch, mix, parts, shingles, tidied

#: Bands and rows a band: at a similarity of 0.8 a pair is missed with odds of 5e-8, at 0.85 of 6e-11.
BANDS, ROWS = 32, 4
#: Bins of the sketch's MinHash samples, and bits of the sketch.
BINS, BITS = 1024, 2048
#: Shingles signed at once, so that the working arrays stay in cache.
CHUNK = 100_000
#: Shingles of all members, and of members apart from the leader, that meet in one group.
MEMBERS, STRAYS = 1_000_000, 250_000
#: Pairs of sketches compared in one step of such a group.
PAIRS_AT_ONCE = 50_000
#: Equal 32-bit fingerprints of different shingles that two documents may have; more have odds of some 1e-12 a pair.
FALSE = 3


def _band_keys(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Band keys (texts x BANDS) of shingle runs that begin at starts."""
    k = BANDS * ROWS
    factors = np.random.default_rng(7).integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    low = np.empty((k, len(starts)), np.uint64)
    work = np.empty_like(values)
    for i in range(k):
        np.multiply(values, factors[i], out=work)
        low[i] = np.minimum.reduceat(work, starts)
    low = mix(low + np.arange(k, dtype=np.uint64)[:, None])
    keys = np.zeros((BANDS, len(starts)), np.uint64)
    for r in range(ROWS):
        keys = mix(keys + low[r::ROWS])
    return keys.T


def odd_sketch(shingle_set: np.ndarray) -> tuple[int, bytes]:
    """(bins that aren't empty, parity bitmap) of a sorted set: the smallest value of each bin flips a bit."""
    bins = shingle_set >> np.uint64(64 - BINS.bit_length() + 1)
    least = shingle_set[np.concatenate(([True], bins[1:] != bins[:-1]))] if len(shingle_set) else shingle_set
    bit = mix(least) >> np.uint64(64 - BITS.bit_length() + 1)
    return len(least), np.packbits((np.bincount(bit.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes()


def likely(odd: np.ndarray, filled: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(estimated similarity, whether it is within five standard deviations of the threshold or above) of pairs.

    odd: set bits of the XOR of two sketches; filled and sizes: sums of both sides' non-empty bins and set sizes.
    The samples that differ number -BITS / 2 * ln(1 - 2 odd / BITS), and half of the rest are shared.
    """
    t = percent / 100
    differ = -BITS / 2 * np.log(np.maximum(1 - 2 * odd / BITS, 1e-3))
    shared = (filled - differ) / 2
    union = sizes / (1 + t)  # at the threshold, as are the bins that the union fills
    bins = BINS * -np.expm1(-union / BINS)
    noise = bins * t * (1 - t) * np.maximum(1 - bins / union, 0.05) + (BITS / 4 * np.expm1(4 * differ / BITS) - differ) / 4 + 1
    return shared / bins, shared >= t * bins - 5 * np.sqrt(noise)


def text_sets(texts, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle fingerprints of each text."""
    texts, out = list(texts), []
    for i, j in parts(texts):
        b = Batch(texts[i:j], lower=True)
        out += [np.unique(shingles(b.hashes[x:y], size)) for x, y in zip(b.offsets[:-1], b.offsets[1:], strict=True)]
    return out


def signatures(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(id, n_shingles, f1, f2, bands, filled, sketch): f1 and f2 name the shingle set, bands are empty for an empty set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = text_sets(pdf["text"], size)
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            f1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
            f2 = np.array([mix(s ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64) for s in sets], np.uint64)
            bands: list = [[] for _ in sets]
            filled, sketch = zip(*map(odd_sketch, sets), strict=True) if sets else ((), ())
            full = np.flatnonzero(n)
            ends = np.cumsum(n[full])
            at = 0
            while at < len(full):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
                part = full[at:to]
                starts = np.concatenate(([0], np.cumsum(n[part])[:-1]))
                for i, keys in zip(part, _band_keys(np.concatenate([sets[i] for i in part]), starts).astype(np.int64), strict=True):
                    bands[i] = keys
                at = to
            yield pd.DataFrame({"id": pdf["id"], "n_shingles": n, "f1": f1.view(np.int64), "f2": f2.view(np.int64), "bands": bands, "filled": filled, "sketch": sketch})

    # ids travel as text, as pandas would turn a column with nulls into floats
    rows = docs.select(F.col(key).cast("long").cast("string").alias("id"), F.col(text).alias("text"))
    made = rows.mapInPandas(tidied(run), "id string, n_shingles long, f1 long, f2 long, bands array<long>, filled int, sketch binary")
    return made.withColumn("id", F.col("id").cast("long"))


def _bits(sketches) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(-1, BITS // 64)


def _likely_pairs(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches are near enough."""
    for end in "ab":
        pairs = pairs.join(reps.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("size", "filled", "sketch")]), end)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            odd = np.bitwise_count(_bits(p["sketch_a"]) ^ _bits(p["sketch_b"])).sum(axis=1)
            good = likely(odd, (p["filled_a"] + p["filled_b"]).to_numpy(), (p["size_a"] + p["size_b"]).to_numpy(), percent)[1]
            yield p.loc[good, ["a", "b"]]

    return pairs.mapInPandas(tidied(run), "a long, b long")


def confirmed(docs: DataFrame, key: str, text: str, size: int, percent: int, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b), a written table, whose full shingle sets have 100 * |both| >= percent * |either|."""
    ids = cut(pairs.select(F.col("a").alias(key)).union(pairs.select(F.col("b").alias(key))).distinct(), "near-ids")
    texts = with_rows_of(docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("text")), ids, key, "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, None
        for pdf in batches:
            others = text_sets(pdf["text_b"], size)
            good = np.zeros(len(pdf), bool)
            for i, (a, t, y) in enumerate(zip(pdf["a"], pdf["text_a"], others, strict=True)):
                if last is None or last != (a, t):
                    last, held = (a, t), text_sets([t], size)[0]
                both = len(np.intersect1d(held, y, assume_unique=True))
                good[i] = both > 0 and 100 * both >= percent * (len(held) + len(y) - both)
            yield pdf.loc[good, ["a", "b"]]

    joined = pairs.select("a", "b").join(texts.select(F.col(key).alias("b"), F.col("text").alias("text_b")), "b")
    return joined.join(texts.select(F.col(key).alias("a"), F.col("text").alias("text_a")), "a").mapInPandas(tidied(run), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every end of the written edges (a, b): label is the smallest id reachable.

    Labels go to neighbours and then jump to their label's label, so rounds grow with the logarithm
    of a component's diameter; each round is written to the shared folder.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    while True:
        heard = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("heard"))
        best = labels.join(heard, "id").select("id", F.col("label").alias("old"), F.least("label", "heard").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("label").alias("far"))
        new = cut(best.join(jump, "low", "left").select("id", "old", F.least("low", F.coalesce("far", "low")).alias("label")), "labels")
        labels = new.select("id", "label")
        if new.where("label <> old").isEmpty():
            return labels


class Bucket:
    """Rows of several groups of bucket members as arrays."""

    def __init__(self, pdf: pd.DataFrame) -> None:
        self.key, self.id, self.comp, self.filled, self.size, self.left = (pdf[c].to_numpy() for c in ("key", "id", "comp", "filled", "size", "left"))
        self.bits, self.bands, self.items = _bits(pdf["sketch"]), np.stack(pdf["bands"].to_numpy()), pdf["items"].to_numpy()
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        order = np.lexsort((self.left, y, x, self.key))
        new = np.logical_or.reduce([c[order[1:]] != c[order[:-1]] for c in (self.key, x, y)])
        self.groups = np.split(order, np.flatnonzero(new) + 1)

    def links(self, group: np.ndarray, percent: int) -> list[np.ndarray]:
        """(apart, member) ids: the best link of each row apart from the leader to each other component in its group."""
        apart, m = group[self.left[group]], group[~self.left[group]]
        out: list[np.ndarray] = []
        if not len(apart) or not len(m):
            return out
        step = max(1, PAIRS_AT_ONCE // len(m))
        for at in range(0, len(apart), step):
            s = apart[at : at + step, None]
            near = likely(np.bitwise_count(self.bits[s] ^ self.bits[m]).sum(axis=2), self.filled[s] + self.filled[m], self.size[s] + self.size[m], percent)[1]
            x, y = np.nonzero(near & (self.comp[s] != self.comp[m]))
            x, y = s[x, 0], m[y]
            # two documents meet in the bucket of their first shared band alone
            first = (self.bands[x] == self.bands[y]).argmax(axis=1)
            here = self.bands[x, first] == self.key[x]
            x, y = x[here], y[here]
            cuts = np.append(np.flatnonzero(np.diff(x, prepend=-1)), len(x))
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                out.append(self._best(x[i], y[i:j], percent))
        return out

    def _best(self, x: int, y: np.ndarray, percent: int) -> np.ndarray:
        """The rows y whose set is similar enough to that of x, from the most similar down to the first of each component that is
        so even if ``FALSE`` fingerprints are equal by chance; those before it are confirmed on the texts as well."""
        own, sets = np.frombuffer(self.items[x], np.uint32), [np.frombuffer(self.items[k], np.uint32) for k in y]
        ends, theirs = np.cumsum([len(s) for s in sets]), np.concatenate(sets)
        found = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
        both = np.add.reduceat(found.astype(np.int64), np.concatenate(([0], ends[:-1])))
        union = len(own) + np.diff(ends, prepend=0) - both
        good = np.flatnonzero(100 * both >= percent * union)
        good = good[np.lexsort((-(both / union)[good], self.comp[y[good]]))]
        sure = (100 * (both - FALSE) >= percent * (union + FALSE))[good].astype(np.int64)
        comp = self.comp[y[good]]
        start = np.flatnonzero(np.concatenate((np.ones(min(len(good), 1), bool), comp[1:] != comp[:-1])))
        before = np.cumsum(sure) - sure
        good = y[good[before == np.repeat(before[start], np.diff(np.append(start, len(good))))]]
        return np.stack([np.full(len(good), self.id[x]), self.id[good]], axis=1)


def _open_links(docs: DataFrame, key: str, text: str, size: int, percent: int, rows: DataFrame, reps: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between components within buckets whose members aren't all of the leader's component, by 32-bit fingerprints."""
    label = labels.withColumnRenamed("label", "comp")
    named = rows.join(label, "id", "left").withColumn("comp", F.coalesce("comp", "id")).join(reps.select("id", "size"), "id")
    named = named.join(label.select(F.col("id").alias("lead"), F.col("comp").alias("lead_comp")), "lead", "left")
    named = named.withColumn("stray", F.col("comp") != F.coalesce("lead_comp", "lead")).select("key", "id", "comp", "size", "stray")
    named = cut(named, "near-named")
    opened = named.groupBy("key").agg(F.sum("size").alias("n"), F.sum(F.when(F.col("stray"), F.col("size"))).alias("s")).where("s > 0")
    named = cut(named.join(opened, "key"), "near-open")
    ids = cut(named.select(F.col("id").alias(key)).distinct(), "near-ids")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = text_sets(pdf["text"], size)
            yield pd.DataFrame({"id": pdf["id"], "items": [(x >> np.uint64(32)).astype(np.uint32).tobytes() for x in sets]})

    texts = with_rows_of(docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("text")), ids, key, "left_semi")
    sets = texts.withColumnRenamed(key, "id").mapInPandas(tidied(read), "id long, items binary")
    wide = named.join(reps.select("id", "bands", "filled", "sketch"), "id").join(sets, "id")
    s_blocks, m_blocks = F.ceil(F.col("s") / STRAYS).cast("int"), F.ceil(F.col("n") / MEMBERS).cast("int")
    part = lambda blocks, seed: F.pmod(F.xxhash64("id", F.lit(seed)), blocks).cast("int")
    kept = ["key", "id", "comp", "size", "bands", "filled", "sketch", "items"]
    strays = wide.where("stray").select(*kept, part(s_blocks, 1).alias("x"), F.explode(F.sequence(F.lit(0), m_blocks - 1)).alias("y"), F.lit(True).alias("left"))
    members = wide.select(*kept, F.explode(F.sequence(F.lit(0), s_blocks - 1)).alias("x"), part(m_blocks, 2).alias("y"), F.lit(False).alias("left"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = Bucket(pdf)
        pairs = np.concatenate([np.zeros((0, 2), np.int64), *[x for g in rows.groups for x in rows.links(g, percent)]])
        return pd.DataFrame({"a": pairs.min(axis=1), "b": pairs.max(axis=1)})

    # small buckets share a group, as calls to Python have a price
    total = named.agg(F.sum("size")).first()[0] or 0
    deal = F.pmod(F.xxhash64("key", "x", "y"), F.lit(int(2 * total // MEMBERS) + 1))
    return strays.unionByName(members).groupBy(deal.alias("deal")).applyInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: (key, n_shingles, component_id, kept).

    Texts are lower-cased (A-Z) and cut into words at ASCII white space; a document's set is its distinct
    shingles of ``size`` words, or its whole sequence where it has fewer. Documents are linked where
    100 * |both| >= percent * |either|; component_id is the smallest id reachable, kept says whether that is
    the row's own. Null or blank texts have no shingles and no links. Rows with a null id get a null
    component and stay. Rows that share an id are one document of all their texts' links, and all stay if it is the smallest.
    """
    sig = cut(signatures(docs, key, text, size), "near-sig")
    classes = sig.where("n_shingles > 0 AND id IS NOT NULL").groupBy("f1", "f2").agg(
        F.min("id").alias("id"), F.count("*").alias("n"), F.any_value("bands").alias("bands"),
        F.any_value("n_shingles").alias("size"), F.any_value("filled").alias("filled"), F.any_value("sketch").alias("sketch"),
    )
    reps = cut(classes, "near-reps")
    bands = reps.select("id", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("members")).where("members > 1")
    rows = cut(bands.join(shared, "key").select("key", "id", "lead"), "near-buckets")
    star = rows.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    pairs = cut(_likely_pairs(star, reps, percent), "near-pairs")
    edges = cut(confirmed(docs, key, text, size, percent, pairs), "near-edges")
    labels = components(edges)
    more = cut(_open_links(docs, key, text, size, percent, rows, reps, labels), "near-more")
    if not more.isEmpty():
        edges = edges.union(cut(confirmed(docs, key, text, size, percent, more), "near-edges"))
        labels = components(edges)
    linked = reps.select("f1", "f2", "id", "n").join(labels, "id", "left").where("n > 1 OR label IS NOT NULL")
    linked = linked.select("f1", "f2", F.coalesce("label", "id").alias("component"))
    out = sig.select("id", "n_shingles", "f1", "f2").join(linked, ["f1", "f2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(
        F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: that with the smallest id."""
    groups = near_duplicates(docs, key, text, size, percent)
    gone = cut(groups.where("NOT kept").select(key).distinct(), "near-gone")
    return with_rows_of(docs, gone, key, "left_anti")


#: For shingles of three words and 85 %.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
m AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM m JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(id, reached) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reached)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(reached) AS component_id FROM r GROUP BY id) c ON c.id = d.doc_id"""
