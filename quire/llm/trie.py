"""The trie of conversation prefixes: how many conversations share each sequence of first turns, and what sharing saves.

Turns are numbered by a range sort and counts of its parts, so that a conversation of any length is numbered by many tasks.
A prefix's digest is the exclusive-or of 128 bits for each of its turns and their places, a running value over blocks of
places; grouping by depth and digest gives the nodes, and each group is checked to have one parent and one last turn.

What a node says of its subtree is added up in arrays. Nodes of a single conversation are chains and need none of it. The
others are cut where at most ``HEAVY`` turns lie below: such subtrees go to shards of a bounded size. A shard gives each of its
digests a slot by a minimal perfect hash, checks that a slot found for a parent holds that digest, scatters counts into flat
arrays by slot, and adds children to parents' slots from the greatest depth up. What shards pass up goes to the few nodes above
the cut, by ranges of depth with a bounded number of nodes (as a rule one).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.scratch import bounded, cut
from quire.llm.words import mix, tidied

#: Places of a conversation over which digests run before blocks are put together.
BLOCK = 4096
#: Turns below a node from which it stands above the shards.
HEAVY = 500_000
#: Nodes of a shard on average, and nodes above the shards that are added up at once.
SHARD_NODES, TOP_NODES = 200_000, 4_000_000
NODE = ["depth", "a", "b"]
SUMS = ["n_children", "n_leaves", "saved"]


def numbered(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, mark1, mark2, chars) of each turn, written: its place from 0 by turn (null first), then role and text; two
    fingerprints of role and text; the text's code points. Null roles and texts are empty; rows without a key are left out.
    """
    rows = conversations.select(F.col(key).cast("long").alias("conv"), F.col(turn).alias("turn"), *[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))])
    order = ["conv", F.asc_nulls_first("turn"), "role", "text", "tie"]  # tie: equal rows may lie in several parts
    rows = rows.where("conv IS NOT NULL").withColumn("tie", F.monotonically_increasing_id())
    marks = [F.xxhash64(F.lit(k), "role", "text").alias(f"mark{k}") for k in (1, 2)]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = cut(ordered.select("conv", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), *marks, F.length("text").cast("long").alias("chars")), "turns")
    parts = ordered.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("conv", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return cut(ordered.join(parts, ["conv", "part"]).select("conv", (F.col("at") + F.col("shift")).alias("place"), "mark1", "mark2", "chars"), "numbered")


def whole(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(steps, sizes) for ``nodes`` of conversations as they are. turns: what ``numbered`` returns."""
    return turns.withColumn("depth", F.col("place") + 1), turns.groupBy("conv").agg(F.count("*").alias("len"))


def with_heads(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(steps, sizes) of rebuilt conversations: each conversation c has the first h turns of conversation c - c % ``every`` (all, if
    it has fewer), then its own after its first h; h is the crc32 of c in decimal modulo ``most``. turns: from ``numbered``."""
    sizes = turns.groupBy("conv").agg(F.count("*").alias("own"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h")
    sizes = sizes.select("conv", "own", h, (F.col("conv") - F.col("conv") % every).alias("base"))
    bases = sizes.where(F.col("conv") == F.col("base")).select("base", F.col("own").alias("given"))
    sizes = sizes.join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("given", F.lit(0))))
    sizes = cut(sizes.select("conv", "base", "h", "head", (F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len")), "sizes")
    heads = turns.where((F.col("conv") % every == 0) & (F.col("place") < most - 1)).withColumnRenamed("conv", "base")
    given = sizes.where("head > 0").join(heads, "base").where("place < head").select("conv", (F.col("place") + 1).alias("depth"), "mark1", "mark2", "chars")
    own = turns.join(sizes, "conv").where("place >= h").select("conv", (F.col("place") - F.col("h") + F.col("head") + 1).alias("depth"), "mark1", "mark2", "chars")
    return given.unionByName(own), sizes.select("conv", "len")


def prefixes(steps: DataFrame, sizes: DataFrame) -> DataFrame:
    """(conv, depth, a, b, pa, pb, mark, chars, len), written: each conversation's prefixes by digest (a, b), that of the prefix before
    (pa, pb), and what the last turn was. The root's digest is (0, 0)."""
    bits = [F.xxhash64(F.lit(k), "depth", "mark1", "mark2").alias(n) for k, n in ((3, "x"), (4, "y"))]
    rows = steps.join(sizes, "conv").withColumn("block", F.floor((F.col("depth") - 1) / BLOCK))
    rows = cut(rows.select("conv", "depth", "block", "len", F.col("mark1").alias("mark"), "chars", *bits), "steps")
    sums = rows.where(F.col("len") > BLOCK).groupBy("conv", "block").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut(sums.select("conv", "block", F.bit_xor("x").over(before).alias("x0"), F.bit_xor("y").over(before).alias("y0")), "blocks")
    to = Window.partitionBy("conv", "block").orderBy("depth")
    rows = rows.select("*", F.bit_xor("x").over(to).alias("a"), F.bit_xor("y").over(to).alias("b")).join(bounded(sums), ["conv", "block"], "left")
    a, b = (F.col(n).bitwiseXOR(F.coalesce(z, F.lit(0))) for n, z in (("a", "x0"), ("b", "y0")))
    rows = rows.select("conv", "depth", a.alias("a"), b.alias("b"), "x", "y", "mark", "chars", "len")
    rows = rows.select("conv", *NODE, F.col("a").bitwiseXOR(F.col("x")).alias("pa"), F.col("b").bitwiseXOR(F.col("y")).alias("pb"), "mark", "chars", "len")
    zero = F.lit(0).cast("long")
    roots = sizes.select("conv", *[zero.alias(n) for n in (*NODE, "pa", "pb", "mark", "chars")], "len")
    return cut(roots.unionByName(rows), "prefixes")


def grouped(rows: DataFrame) -> DataFrame:
    """One row a node, with its parent's digest; an error where two prefixes share a depth and a digest."""
    one = reduce(Column.__and__, (F.min(c) == F.max(c) for c in ("pa", "pb", "mark", "chars")))
    ends = F.count(F.when(F.col("depth") == F.col("len"), 1))
    n = F.when(one, F.count("*")).otherwise(F.raise_error(F.lit("two prefixes share a digest")).cast("long"))
    return rows.groupBy(*NODE).agg(F.min("conv").alias("conv_id"), n.alias("n_convs"), *[F.min(c).alias(c) for c in ("pa", "pb", "chars")], ends.alias("n_ends"), F.sum(F.col("len") - F.col("depth") + 1).alias("below"))


class Slots:
    """A minimal perfect hash of distinct digests, in levels of bits: what lies alone at its place of a level has the number of
    that bit as its slot; the rest goes to the next level."""

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        self.levels, used, left, self.slot = [], 0, np.arange(len(a)), np.empty(len(a), np.int64)
        while len(left):
            if len(self.levels) == 100:
                raise ValueError("two nodes share a digest")
            size = 2 * len(left) + 64
            at = self._place(a[left], b[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            rank = used + np.cumsum(alone) - 1
            self.levels.append((alone, rank))
            own = alone[at]
            self.slot[left[own]] = rank[at[own]]
            used, left = used + int(alone.sum()), left[~own]
        self.a, self.b = np.empty_like(a), np.empty_like(b)
        self.a[self.slot], self.b[self.slot] = a, b

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(a + mix(b + np.uint64(level))) % np.uint64(size)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots of digests, -1 for those that the table doesn't hold."""
        out, left = np.full(len(a), -1), np.arange(len(a))
        for level, (alone, rank) in enumerate(self.levels):
            at = self._place(a[left], b[left], level, len(alone))
            own = alone[at]
            out[left[own]] = rank[at[own]]
            left = left[~own]
        wrong = (self.a[out] != a) | (self.b[out] != b) if len(self.a) else np.ones(len(a), bool)
        out[wrong] = -1
        return out


def added_up(nodes: pd.DataFrame) -> pd.DataFrame:
    """``nodes`` (depth, a, b, pa, pb, n_convs, chars and what children elsewhere pass up, in ``SUMS``) with sums over subtrees, and
    ``up`` where the parent isn't among them."""
    depth = nodes["depth"].to_numpy()
    # the depth is mixed in, as digests are told apart by depth as well
    a, pa_ = (nodes[c].to_numpy().view(np.uint64) ^ mix((depth - k).astype(np.uint64)) for c, k in (("a", 0), ("pa", 1)))
    b, pb = (nodes[c].to_numpy().view(np.uint64) for c in ("b", "pb"))
    slots = Slots(a, b)
    parent, level = np.empty(len(nodes), np.int64), np.empty(len(nodes), np.int64)
    parent[slots.slot] = np.where(depth > 0, slots.find(pa_, pb), -1)
    level[slots.slot] = depth
    sums = {c: np.empty(len(nodes), np.int64) for c in SUMS}
    for c in SUMS:
        sums[c][slots.slot] = nodes[c].to_numpy()
    children = np.bincount(parent[parent >= 0], minlength=len(nodes))
    sums["n_children"] += children
    sums["n_leaves"] += sums["n_children"] == 0
    own = (nodes["n_convs"].to_numpy() - 1) * nodes["chars"].to_numpy()
    sums["saved"][slots.slot] += own
    order = np.argsort(-level, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(level[order])) + 1):
        part = part[parent[part] >= 0]
        for c in ("n_leaves", "saved"):
            np.add.at(sums[c], parent[part], sums[c][part])
    out = nodes[["depth", "a", "b", "pa", "pb"]].copy()
    for c in SUMS:
        out[c] = sums[c][slots.slot]
    out["up"] = parent[slots.slot] < 0
    return out


SUMMED = "depth long, a long, b long, pa long, pb long, n_children long, n_leaves long, saved long, up boolean"


def _passed_up(nodes: DataFrame) -> DataFrame:
    """By parent: children, and what they have to add."""
    return nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))


def _with(nodes: DataFrame, passed: DataFrame) -> DataFrame:
    """``nodes`` for ``added_up``, with what is passed up to them."""
    zero = F.lit(0).cast("long")
    return nodes.select(*NODE, "pa", "pb", "n_convs", "chars").join(passed, NODE, "left").select(*NODE, "pa", "pb", "n_convs", "chars", *[F.coalesce(c, zero).alias(c) for c in SUMS])


def _subtrees(shared: DataFrame, chains: DataFrame, rows: DataFrame, total: int) -> DataFrame:
    """(depth, a, b, n_children, n_leaves, saved) of nodes with several members. chains: single conversations' first own nodes."""
    from_chains = _passed_up(chains.select(*NODE, "pa", "pb", F.lit(1).alias("n_leaves"), F.lit(0).alias("saved")))
    shared = cut(shared.join(from_chains, NODE, "left").select(*[shared[c] for c in (*NODE, "pa", "pb", "conv_id", "n_convs", "chars", "below")], *SUMS), "shared")
    passed = shared.select(*NODE, *SUMS).where("n_children IS NOT NULL")
    heavy = (F.col("below") > HEAVY) | (F.col("depth") == 0)
    top = cut(shared.where(heavy), "top")
    light = shared.where(~heavy)
    # where a conversation's path leaves the heavy nodes is the root of its subtree
    leaving = rows.join(bounded(top.select(*NODE, F.lit(1).alias("above"))), NODE, "left").where("above IS NULL")
    leaving = leaving.groupBy(F.col("conv").alias("conv_id")).agg(F.min_by("a", "depth").alias("ra"), F.min_by("b", "depth").alias("rb"))
    shards = -(-light.count() // SHARD_NODES)
    done = []
    if shards:
        dealt = light.join(leaving, "conv_id").withColumn("shard", F.pmod(F.xxhash64("ra", "rb"), F.lit(shards)))
        dealt = dealt.select("shard", *NODE, "pa", "pb", "n_convs", "chars", *[F.coalesce(c, F.lit(0)).alias(c) for c in SUMS])
        done = [cut(dealt.groupBy("shard").applyInPandas(lambda pdf: added_up(pdf.drop(columns="shard")), SUMMED), "subtrees")]
        passed = passed.unionByName(_passed_up(done[0].where("up")))
    # at one depth at most total / HEAVY nodes have more than HEAVY turns below
    width = max(1, TOP_NODES // (total // HEAVY + 1))
    for low in reversed(range(0, 1 + (top.agg(F.max("depth")).first()[0] or 0), width)):
        part = _with(top.where(F.col("depth").between(low, low + width - 1)), passed.groupBy(*NODE).agg(*[F.sum(c).alias(c) for c in SUMS]))
        done.append(cut(part.groupBy().applyInPandas(added_up, SUMMED), "top-sums"))
        passed = passed.unionByName(_passed_up(done[-1].where("up AND depth > 0")))
    return reduce(DataFrame.unionByName, done).drop("pa", "pb", "up")


def ends(rows: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of nodes where conversations end: SHA-256 of their decimal ids, ascending, joined by commas.

    The ids are sorted by ranges, so those of one node may lie in many tasks, and joined there; only the pieces of a node, by
    order, meet in the one task that a running hash needs. It holds a batch of pieces at a time.
    """
    order = ["a", "b", "depth", "conv"]

    def runs(b: pa.RecordBatch) -> Iterator[tuple[int, int]]:
        keys = np.stack([b.column(c).to_numpy() for c in NODE])
        cuts = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0), [True]))) if b.num_rows else [0]
        yield from zip(cuts[:-1], cuts[1:], strict=True)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, ids = list(runs(b)), b.column("conv").to_pylist()
            first = b.take(pa.array([i for i, _ in at], pa.int64()))
            yield pa.RecordBatch.from_arrays([*first.columns, pa.array([",".join(map(str, ids[i:j])) for i, j in at], pa.string())], [*first.schema.names, "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running = None, None
        for b in batches:
            out, ids = [], b.column("ids").to_pylist()
            for key, piece in zip(zip(*[b.column(c).to_pylist() for c in NODE], strict=True), ids, strict=True):
                if key == now:
                    running.update(b"," + piece.encode())
                    continue
                if now:
                    out.append((*now, running.hexdigest()))
                now, running = key, hashlib.sha256(piece.encode())
            yield hashes(out)
        yield hashes([(*now, running.hexdigest())] if now else [])

    def hashes(out: list[tuple[int, int, int, str]]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (*[pa.int64()] * 3, pa.string()), strict=True)], [*NODE, "ends_sha256"])

    ended = rows.where("depth = len").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = cut(ended.mapInArrow(tidied(joined), "a long, b long, depth long, conv long, ids string"), "ends")
    return pieces.repartition("a", "b", "depth").sortWithinPartitions(*order).mapInArrow(tidied(hashed), "depth long, a long, b long, ends_sha256 string")


def nodes(steps: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row for each distinct sequence of first turns, from the empty one (depth 0) on.

    conv_id, the smallest member's; depth; parent_conv_id (root: null); n_convs, members; n_children; n_leaves, nodes without
    children in its subtree; saved_tokens, over its subtree the sum of (n_convs - 1) times the last text's code points;
    ends_sha256, of the ids of members that have no further turn; and the digest (a, b).

    steps: (conv, depth from 1, mark1, mark2, chars) of each turn; sizes: (conv, len) of each conversation, also those of no
    turn, which end at the root. Without conversations there is no node, not even the root. Equal turns are one node wherever
    their rows stand; turns repeated in one conversation are turns of their own.
    """
    rows = prefixes(steps, sizes)
    found = cut(grouped(rows), "nodes")
    shared = found.where("n_convs > 1 OR depth = 0")
    parents = shared.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("above"))
    linked = cut(found.where("depth > 0").join(parents, ["depth", "pa", "pb"], "left"), "linked")
    chain = linked.where("n_convs = 1")
    total = rows.count()
    sums = _subtrees(shared, chain.where("above IS NOT NULL"), rows, total)
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    parent = F.coalesce("above", "conv_id").alias("parent_conv_id")
    chains = chain.select(*NODE, "conv_id", parent, "n_convs", F.when(F.col("n_ends") > 0, zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved"))
    several = linked.where("n_convs > 1").select(*NODE, "conv_id", parent, "n_convs")
    root = found.where("depth = 0").select(*NODE, "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs")
    every = several.unionByName(root).join(sums, NODE).unionByName(chains).join(ends(rows), NODE, "left")
    return every.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "a", "b")


def prefix_trie(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``nodes`` of conversations as they are: ordered by turn (null first), then role and text; null roles and texts are empty,
    rows without a key are left out, further columns aren't looked at. Keys are numbers."""
    return nodes(*whole(numbered(conversations, key, turn, role, text)))


_BITS = "flatten(list_transform(range(1, len(s) + 1), lambda k: [ord(s[k]), -1, -1, -1, -1, -1, -1, -1, -1]))"
_CRC = f"xor(list_reduce(list_prepend(4294967295, {_BITS}), lambda v, x: CASE WHEN x >= 0 THEN xor(v, x) ELSE xor(v >> 1, 3988292384 * (v & 1)) END), 4294967295)"
ORACLE = f"""
WITH own AS (
  SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS steps
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
h AS (SELECT c, steps, CAST({_CRC} % 6 AS BIGINT) AS h FROM (SELECT c, steps, CAST(c AS VARCHAR) AS s FROM own)),
paths AS (
  SELECT h.c, list_concat(coalesce(list_slice(b.steps, 1, h), []), list_slice(h.steps, h + 1, len(h.steps))) AS path
  FROM h LEFT JOIN own b ON b.c = h.c - h.c % 100
),
p AS (SELECT c, len(path) AS size, d, list_slice(path, 1, d) AS node FROM (SELECT c, path, unnest(range(0, len(path) + 1)) AS d FROM paths)),
n AS (
  SELECT node, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (size = d), '')) AS ends_sha256
  FROM p GROUP BY node, d
),
k AS (SELECT list_slice(node, 1, d - 1) AS node, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
f AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf,
    CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * length(n.node[n.d].t) END AS saved
  FROM n LEFT JOIN k ON n.node = k.node AND n.d = k.d
),
s AS (
  SELECT list_slice(node, 1, up) AS node, up AS d, sum(leaf) AS n_leaves, sum(saved) AS saved
  FROM (SELECT node, leaf, saved, unnest(range(0, d + 1)) AS up FROM f) GROUP BY ALL
)
SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN s ON f.node = s.node AND f.d = s.d LEFT JOIN n u ON f.d > 0 AND u.d = f.d - 1 AND u.node = list_slice(f.node, 1, f.d - 1)
"""
