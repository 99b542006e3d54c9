"""Ranked lexical search: the best documents for each item by impact lists and the Best Position Algorithm.

Items are taken in blocks of a bounded number of terms. One pass over the documents keeps, for each, its length and how often
it holds which of the block's terms; collection counts are sums over that table. Its rows are dealt at random into shards of
a bounded number of postings. A shard sorts, for each term, its documents by falling impact and answers each item: blocks of
positions are read from all the item's lists at once, every document met there is scored in full by direct access to its
places in the other lists, and those places count as seen too. In each list the first place that isn't seen bounds what any
document not met can still get from it; the search ends when the sum of these bounds is strictly below the k-th score, so that
no document of an equal score and a smaller id is lost. The shards' best meet in one window with a limit before the shuffle.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.scratch import cut
from quire.llm.words import tidied, tidy

#: ASCII letters and digits and all that isn't ASCII, over UTF-8 bytes whose A-Z are lower-cased.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Pairs of an item and a term that are searched in one pass over the documents.
BLOCK_PAIRS = 500_000
#: Postings of a shard, on average.
SHARD_POSTINGS = 1_000_000
#: Positions read from each list at first; doubled until the last.
FIRST_READ, LAST_READ = 32, 2048


def terms_of(text: str | None) -> list[bytes]:
    return TERM.findall((text or "").encode("utf-8", "replace").lower())


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct (item, term) of all items. Rows that share an id, null included, are one item with the terms of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(set(terms_of(t))) for t in b.column("text").to_pylist()]
            row = np.repeat(np.arange(len(found)), [len(f) for f in found])
            term = pa.array([t.decode("utf-8", "replace") for f in found for t in f], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("item").take(pa.array(row)), term], ["item", "term"])

    rows = items.select(F.col(key).alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(tidied(run), f"item {rows.schema['item'].dataType.simpleString()}, term string").distinct()


def postings(docs: DataFrame, key: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(id, part, row, n, terms, tfs) for each document with a term: its number of terms, and which of ``vocabulary`` it has and
    how often, as packed numbers. (part, row) tells rows apart."""
    told = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, row, part = told.value, 0, TaskContext.get().partitionId()
        for b in batches:
            n, terms, tfs = [], [], []
            for t in b.column("text"):
                counts = Counter(terms_of(t.as_py()))
                known = sorted((number[w], c) for w, c in counts.items() if w in number)
                n.append(counts.total())
                terms.append(np.array([i for i, _ in known], "<i4").tobytes())
                tfs.append(np.array([c for _, c in known], "<i8").tobytes())
            own = [pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())]
            rows = pa.array(np.arange(row, row + len(n)))
            row += len(n)
            out = pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.full(len(n), part, np.int32)), rows, *own], ["id", "part", "row", "n", "terms", "tfs"])
            yield out.filter(pc.greater(out.column("n"), 0))

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(tidied(run), f"id {rows.schema['id'].dataType.simpleString()}, part int, row long, n long, terms binary, tfs binary")


def frequencies(posted: DataFrame, size: int) -> DataFrame:
    """(term, df): documents that hold each term; a task adds up its own before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for b in batches:
            df += np.bincount(np.frombuffer(b"".join(b.column("terms").to_pylist()), "<i4"), minlength=size)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(df[held])], ["term", "df"])

    return posted.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of several ranges, one after another."""
    n = end - start
    return np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())


class Shard:
    """Impact lists of some documents, which are numbered in the order of their ids.

    A posting is a document's entry for a term. ``docs`` and ``impacts`` are in list order (by term, falling impact, document);
    ``place`` and ``term`` are in document order, ``place`` being where in list order a posting stands.
    """

    def __init__(self, n: np.ndarray, of: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray, n_docs: int, total: int) -> None:
        m = 10 + (90 * n * n_docs) // total
        impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[of]))
        some = impact > 0
        of, self.term, impact = of[some], term[some], impact[some]
        order = np.lexsort((of, -impact, self.term))
        self.docs, self.impacts = of[order], impact[order]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.bounds = np.searchsorted(self.term[order], np.arange(len(weights) + 1))
        self.of_doc = np.searchsorted(of, np.arange(len(n) + 1))
        self.seen, self.met, self.asked = np.zeros(len(order), bool), np.zeros(len(n), bool), np.zeros(len(weights), bool)

    def best(self, terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k highest scores above 0, equal ones by document."""
        at, end = self.bounds[terms], self.bounds[terms + 1]
        at, end = at[at < end], end[at < end]
        self.asked[terms] = True
        top, score, step, marked, found = np.zeros(0, np.int64), np.zeros(0, np.int64), FIRST_READ, [], []
        while True:
            bound = self.impacts[at[at < end]].sum()
            if bound == 0 or (len(top) == k and bound < score[-1]):
                break
            new = np.unique(self.docs[ranges(at, np.minimum(at + step, end))])
            new = new[~self.met[new]]
            self.met[new] = True
            found.append(new)
            reached = ranges(self.of_doc[new], self.of_doc[new + 1])
            owner = np.repeat(np.arange(len(new)), self.of_doc[new + 1] - self.of_doc[new])
            mine = self.asked[self.term[reached]]
            places, sums = self.place[reached[mine]], np.zeros(len(new), np.int64)
            np.add.at(sums, owner[mine], self.impacts[places])
            self.seen[places] = True
            marked.append(places)
            top, score = np.concatenate((top, new)), np.concatenate((score, sums))
            first = np.lexsort((top, -score))[:k]
            top, score = top[first], score[first]
            for i in range(len(at)):
                at[i] = self._unseen(at[i], end[i])
            step = min(2 * step, LAST_READ)
        for places, docs in zip(marked, found, strict=True):
            self.seen[places], self.met[docs] = False, False
        self.asked[terms] = False
        return top, score

    def _unseen(self, at: int, end: int) -> int:
        """The first place of a list that isn't seen, or its end."""
        while at < end:
            part = self.seen[at : min(at + LAST_READ, end)]
            if (k := int(part.argmin())) or not part[0]:
                return at + k
            at += len(part)
        return at


def _search_block(docs: DataFrame, pairs: pa.Table, kind: str, key: str, text: str, k: int) -> DataFrame:
    """(item, id, score): each shard's best for the items of one block, whose (item, term) are in ``pairs``; kind: the type of item."""
    spark = docs.sparkSession
    words = pairs.column("term").unique().to_pylist()
    number = {w.encode(): i for i, w in enumerate(words)}
    pairs = pairs.sort_by("item")
    names = pairs.column("item").combine_chunks()
    codes = names.dictionary_encode(null_encoding="encode")
    items, item = codes.dictionary, codes.indices.to_numpy(zero_copy_only=False)
    term = np.array([number[w.encode()] for w in pairs.column("term").to_pylist()], np.int64)
    by_item = np.argsort(item, kind="stable")
    asked = np.split(term[by_item], np.searchsorted(item[by_item], np.arange(1, len(items))))

    posted = cut(postings(docs, key, text, number), "postings")
    n_docs, total = posted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(cut(frequencies(posted, len(words)), "frequencies").collect())  # a row for each of the block's terms at most
    weights = np.array([weight(n_docs, df.get(i, 0)) for i in range(len(words))], np.int64)
    told = spark.sparkContext.broadcast((asked, items, weights, n_docs, total))
    shards = max(1, -(-sum(df.values()) // SHARD_POSTINGS))

    def search(rows: pa.Table) -> pa.Table:
        asked, items, weights, n_docs, total = told.value
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("id", "ascending")], null_placement="at_end"))
        terms = rows.column("terms").to_pylist()
        of = np.repeat(np.arange(len(terms)), [len(t) // 4 for t in terms])
        term = np.frombuffer(b"".join(terms), "<i4").astype(np.int64)
        tf = np.frombuffer(b"".join(rows.column("tfs").to_pylist()), "<i8")
        shard = Shard(rows.column("n").to_numpy(), of, term, tf, weights, n_docs, total)
        best = [shard.best(t, k) for t in asked]
        who = np.repeat(np.arange(len(best)), [len(d) for d, _ in best])
        found = pa.array(np.concatenate([d for d, _ in best]))
        out = pa.table({"item": items.take(pa.array(who)), "id": rows.column("id").take(found), "score": np.concatenate([s for _, s in best])})
        del shard
        tidy()
        return out

    dealt = posted.where(F.octet_length("terms") > 0).withColumn("shard", F.pmod(F.xxhash64("part", "row"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(search, f"item {kind}, id {posted.schema['id'].dataType.simpleString()}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, rank, doc, score): for each item its ``k`` documents of the highest score above 0, equal scores by ascending id.

    docs and items: tables with their key, of any type that sorts, and ``text``; further columns are not looked at.
    Null, empty and blank texts have no terms: such documents are never found, such items have no rows. Rows of ``docs`` that
    share an id are documents of their own; a null id comes last. Rows of ``items`` that share an id are one item. Rows of the
    same text tie, and their ids decide. An empty table on either side gives no rows. The result's columns are named as the
    keys, or ``item`` and ``doc`` if both keys have the same name.
    """
    spark = docs.sparkSession
    pairs = cut(item_terms(items, item_key, text), "item-terms")
    blocks = -(-pairs.count() // BLOCK_PAIRS)
    names = ("item", "doc") if item_key == doc_key else (item_key, doc_key)
    kinds = items.schema[item_key].dataType.simpleString(), docs.schema[doc_key].dataType.simpleString()
    found = []
    for b in range(blocks):
        mine = pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).toArrow()
        if mine.num_rows:
            found.append(cut(_search_block(docs, mine, kinds[0], doc_key, text, k), "found"))
    if not found:
        return spark.createDataFrame([], f"`{names[0]}` {kinds[0]}, rank int, `{names[1]}` {kinds[1]}, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = reduce(DataFrame.unionAll, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(names[0]), "rank", F.col("id").alias(names[1]), "score")


_CASE = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"
_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), {_CASE}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
d AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
total AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(terms)) AS BIGINT) AS terms FROM d WHERE len(terms) > 0),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, total GROUP BY term),
s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total.terms)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), total GROUP BY ALL
),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""
