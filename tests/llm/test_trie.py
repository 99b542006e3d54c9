"""The prefix trie against dictionaries of tuples."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from quire.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(paths):
    """paths: {conv: [(role, text), ...]} as finally told."""
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children, subtree = defaultdict(list), defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
        for d in range(len(node) + 1):
            subtree[node[:d]].append(node)
    out = set()
    for node, who in members.items():
        ended = sorted(c for c in who if len(paths[c]) == len(node))
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in subtree[node] if x)
        leaves = sum(not children[x] for x in subtree[node])
        parent = min(members[node[:-1]]) if node else None
        out.add((min(who), len(node), parent, len(who), len(children[node]), leaves, saved, hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest()))
    return out


def told(rows):
    got = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            got[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in got.items()}


def rebuilt(paths):
    out = {}
    for c, path in paths.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = paths.get(c - c % 100 if c >= 0 else c + (-c) % 100, [])[:h] + path[h:]
    return out


def conversations(seed, n=60, deep=9):
    r = random.Random(seed)
    ids = r.sample(range(350), n) + [1000, 1001, 10**12]
    rows = []
    for c in ids:
        for turn in range(r.randint(1, deep)):
            rows.append((c, turn, r.choice(["user", "assistant", None]), r.choice(["a", "b", "é😀", None, ""]) if turn < 3 else f"{c % 3} {turn}"))
    rows += [(1000, None, "user", "first"), (1000, 3, "x", "tie"), (1000, 3, "a", "tie"), (1000, 3, "a", "tie"), (None, 1, "user", "no key"), (None, None, None, None)]
    r.shuffle(rows)
    return rows


def columns(df):
    return {tuple(r)[:8] for r in df.collect()}


@pytest.mark.parametrize(("seed", "heavy", "shard", "top", "block"), [(1, 500_000, 200_000, 4_000_000, 4096), (2, 6, 5, 4, 2), (3, 0, 5, 1000, 3)])
def test_trie(spark, monkeypatch, seed, heavy, shard, top, block):
    for name, value in (("HEAVY", heavy or 1), ("SHARD_NODES", shard), ("TOP_NODES", top), ("BLOCK", block)):
        monkeypatch.setattr(trie, name, value)
    rows = conversations(seed)
    paths = told(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    got = trie.prefix_trie(df)
    assert columns(got) == plain(paths) and got.count() == len(plain(paths))
    again = trie.nodes(*trie.with_heads(trie.numbered(df)))
    assert columns(again) == plain(rebuilt(paths))


def test_conversations_without_turns_and_empty_tables(spark):
    rows = [(101, 0, "u", "a"), (c, 0, "u", "b")] if (c := next(c for c in range(200, 300) if zlib.crc32(str(c).encode()) % 6)) else []
    df = spark.createDataFrame(rows, SCHEMA)
    got = columns(trie.nodes(*trie.with_heads(trie.numbered(df))))
    assert got == plain(rebuilt(told(rows)))
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    named = spark.createDataFrame([(1, 1, "u", "a", "x"), (1, 2, "u", None, "y")], "id int, turn int, speaker string, said string, depth string")
    assert columns(trie.prefix_trie(named, "id", "turn", "speaker", "said")) == plain({1: [("u", "a"), ("u", "")]})


def test_a_hot_prefix_a_long_conversation_and_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(trie, "HEAVY", 300)
    monkeypatch.setattr(trie, "TOP_NODES", 2000)
    rows = [(c, 0, "system", "hello") for c in range(1500)] + [(c, 1, "user", f"q{c % 7}") for c in range(0, 1500, 2)]
    rows += [(5000 + k, t, "user", f"turn {t}") for k in range(2) for t in range(600)] + [(7000, 0, "user", "same")] * 500
    paths = told(rows)
    got = columns(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    by = {(r[0], r[1]): r for r in got}
    assert len(got) == 1 + 1 + 7 + 600 + 500
    assert by[0, 0][3:6] == (1503, 3, 7 + 1 + 1)
    assert by[0, 1][3:8] == (1500, 7, 7, 1499 * 5 + sum((len([c for c in range(0, 1500, 2) if c % 7 == k]) - 1) * 2 for k in range(7)), hashlib.sha256(",".join(map(str, range(1, 1500, 2))).encode()).hexdigest())
    texts = [len(f"turn {t}") for t in range(600)]
    assert all(by[5000, d][3:7] == (2, d < 600, 1, sum(texts[max(d - 1, 0) :])) for d in range(1, 601))
    assert all(by[7000, d][2:7] == (0 if d == 1 else 7000, 1, d < 500, 1, 0) for d in range(1, 501))
    assert len(paths) == 1503


def test_slots():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 2**64, (2, 20_000), dtype=np.uint64)
    s = trie.Slots(a, b)
    assert sorted(s.slot) == list(range(20_000)) and (s.find(a, b) == s.slot).all()
    assert (s.find(a, b + np.uint64(1)) == -1).all() and (trie.Slots(a[:0], b[:0]).find(a[:3], b[:3]) == -1).all()
    with pytest.raises(ValueError, match="share"):
        trie.Slots(a[[0, 1, 0]], b[[0, 1, 0]])


def test_sums_of_one_part():
    """Two trees of one part, one of which has its parent elsewhere."""
    rows = [(0, 0, 0, 0, 0, 5, 0), (1, 1, 1, 0, 0, 3, 4), (1, 2, 2, 0, 0, 2, 10), (2, 3, 3, 1, 1, 2, 7), (4, 9, 9, 8, 8, 2, 1), (5, 10, 10, 9, 9, 2, 2)]
    nodes = pd.DataFrame(rows, columns=["depth", "a", "b", "pa", "pb", "n_convs", "chars"]).assign(n_children=0, n_leaves=0, saved=0)
    nodes.loc[3, ["n_children", "n_leaves", "saved"]] = (2, 3, 11)
    got = trie.added_up(nodes)
    assert got[["n_children", "n_leaves", "saved", "up"]].values.tolist() == [[2, 4, 36, True], [1, 3, 26, False], [0, 1, 10, False], [2, 3, 18, False], [1, 1, 3, True], [0, 1, 2, False]]
