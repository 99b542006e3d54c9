"""Ranked search against every document scored in plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quire.llm import lexical
from quire.llm.scratch import cut
from tests.llm.helpers import SCHEMA, lower, odd_documents, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs, items, k):
    """docs: (id, text); items: (id, text)."""
    bags = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, total = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall(lower(t)))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, b in bags:
            m = 10 + (90 * b.total() * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m)) for t in terms if t in b)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def items():
    base = [prose(i, 60 + 7 * i) for i in range(12)]
    return [(i, " ".join(b.split()[5 : 12 + i])) for i, b in enumerate(base)] + [(50, "ß STRASSE ñandú é 😀"), (51, None), (52, " .,; "), (53, "absentterm"), (54, "one"), (54, "Two words"), (None, base[1]), (55, "same LINE same")]


@pytest.fixture(scope="module")
def docs(spark):
    return cut(spark.createDataFrame(odd_documents(), SCHEMA), "test-docs")


@pytest.mark.parametrize(("k", "shard", "pairs"), [(10, 1_000_000, 500_000), (3, 60, 40), (1, 500, 500_000)])
def test_search_finds_what_scoring_every_document_finds(spark, docs, monkeypatch, k, shard, pairs):
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", shard)
    monkeypatch.setattr(lexical, "BLOCK_PAIRS", pairs)
    got = lexical.search(docs, spark.createDataFrame(items(), "item_id long, text string"), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain([r[:2] for r in odd_documents()], items(), k)


def test_search_by_names_and_over_empty_tables(spark, docs):
    none = lexical.search(docs.limit(0), spark.createDataFrame(items(), "item_id long, text string"))
    assert none.count() == 0 and [f.dataType.simpleString() for f in none.schema] == ["bigint", "int", "bigint", "bigint"]
    assert lexical.search(docs, spark.createDataFrame([], "item_id string, text string")).count() == 0
    named = spark.createDataFrame([("b", "two words", 1), ("a", "one", 2)], "id string, text string, score int")
    texts = spark.createDataFrame([("x", "one or two"), ("y", "Words, words"), ("z", "three"), ("z", "three")], "id string, text string")
    got = lexical.search(texts, named, doc_key="id", item_key="id")
    assert sorted(map(tuple, got.collect())) == plain([("x", "one or two"), ("y", "Words, words"), ("z", "three"), ("z", "three")], [("b", "two words"), ("a", "one")], 10)


def test_reading_stops_early_and_only_strictly_below(monkeypatch):
    """Lists of 5,000 documents: the best are found after few reads; equal scores further down the lists come by document."""
    monkeypatch.setattr(lexical, "FIRST_READ", 1)
    r = random.Random(3)
    n = np.array([40 + r.randint(0, 30) for _ in range(5000)])
    n[[7, 4000, 4900]] = 40
    of, term = np.repeat(np.arange(5000), 3), np.tile(np.arange(3), 5000)
    tf = np.array([r.randint(1, 4) for _ in of])
    for d in (7, 4000, 4900):
        tf[of == d] = 30
    shard = lexical.Shard(n, of, term, tf, np.array([900, 700, 500]), 5000, int(n.sum()))
    touched = []
    once = shard._unseen
    monkeypatch.setattr(shard, "_unseen", lambda a, e: touched.append(1) or once(a, e))
    top, score = shard.best(np.arange(3), 2)
    assert top.tolist() == [7, 4000] and score[0] == score[1]
    assert len(touched) <= 3 * 4
    assert not shard.seen.any() and not shard.met.any() and not shard.asked.any()
