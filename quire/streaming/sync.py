"""Merging journals as a stream: each chapter's pending operations and clocks are state, remote entries are transformed past them.

A replica's stream has its own edits and the entries of others, keyed by document and chapter. State holds what is pending (own
operations that no one else has yet, a list), how far each other user has come (a map) and entries that came before their time (a map
by user and sequence). So entries of a user that come twice, late or in another order give the same operations.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.operators.versions import ALIGNMENT_OPS, _after

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OP = "struct<op:string,path:array<int>,`to`:array<int>,attr:string,value:string,old:string>"
ENTRY = f"doc string, chapter int, user string, sequence long, layer string, ops array<{OP}>"
MERGED = f"doc string, chapter int, user string, sequence long, status string, ops array<{OP}>, pending long"
FIELDS = ("op", "path", "to", "attr", "value", "old")
POLICIES = ("manual", "accept-local", "accept-remote")


def merged(own: list[dict], other: list[dict]) -> tuple[list[dict], list[dict], bool]:
    """(other after own, own after other, whether an operation of either was lost to the other's): two lists made side by side.

    Each operation of one side is carried past those of the other, and these past it, so that both meet what the other list has
    become by then.
    """
    server, lost = [], False
    for op in other:
        left = []
        for mine in own:
            passed = None if op is None else _after(mine, op)
            stays = mine if op is None else _after(op, mine)
            lost = lost or passed is None and op is not None or stays is None
            op, left = passed, left + ([] if stays is None else [stays])
        own = left
        server += [] if op is None else [op]
    return server, own, lost


class Merger(StatefulProcessor):
    """One chapter of one document at one replica."""

    def __init__(self, me: str, policy: str) -> None:
        self.me, self.policy = me, policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getListState("pending", "op string")
        self.clocks = handle.getMapState("clocks", "user string", "sequence long")
        self.waiting = handle.getMapState("waiting", "user string, sequence long", "entry string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pending = [json.loads(x[0]) for x in self.pending.get()] if self.pending.exists() else []
        out: list[tuple] = []
        came = pd.concat(list(rows)).to_dict("records")
        # states are asked and told once a user and not once an entry: clocks as far as they have come, and what came early before
        clocks: dict[str, int] = {}
        early = {(user, sequence) for user, sequence in self.waiting.keys()} if self.waiting.exists() else set()
        arrived: dict[tuple[str, int], dict] = {}

        def following(user: str) -> int:
            if user not in clocks:
                clocks[user] = self.clocks.getValue((user,))[0] if self.clocks.containsKey((user,)) else 0
            return clocks[user] + 1

        # one's own edits are made before what arrives with them; the rest in an order that doesn't depend on arrival
        for r in sorted(came, key=lambda r: (r["user"] != self.me, r["sequence"], r["user"])):
            entry = {"layer": r["layer"], "ops": [_plain(o) for o in r["ops"]]}
            if r["user"] == self.me:
                if following(r["user"]) == r["sequence"]:
                    clocks[self.me] = r["sequence"]
                    ops = _content(entry)
                    pending += ops
                    out.append((*key, self.me, r["sequence"], "local", ops, len(pending)))
            elif r["sequence"] >= following(r["user"]):
                arrived[r["user"], r["sequence"]] = entry
        todo = sorted({r["user"] for r in came if r["user"] != self.me})
        for user in todo:
            while (at := (user, following(user))) in arrived or at in early:
                entry = arrived.pop(at, None)
                if at in early:
                    entry = entry or json.loads(self.waiting.getValue(at)[0])
                    self.waiting.removeKey(at)
                    early.discard(at)
                clocks[user] = at[1]
                status, ops, pending = self._merge(entry, pending)
                out.append((*key, user, at[1], status, ops, len(pending)))
        for at, entry in arrived.items():
            self.waiting.updateValue(at, (json.dumps(entry),))
        for user, sequence in clocks.items():
            if sequence:
                self.clocks.updateValue((user,), (sequence,))
        self.pending.clear()
        if pending:
            self.pending.put([(json.dumps(o),) for o in pending])
        if out:
            yield pd.DataFrame(out, columns=["doc", "chapter", "user", "sequence", "status", "ops", "pending"])

    def _merge(self, entry: dict, pending: list[dict]) -> tuple[str, list[dict], list[dict]]:
        if entry["layer"] != "content":
            return "recorded", [], pending
        remote = _content(entry)
        server, own, lost = merged(pending, remote)
        if not lost:
            return "merged", server, own
        if self.policy == "accept-local":
            return "kept local", [], pending
        if self.policy == "accept-remote":
            return "took remote", remote, []
        return "conflict", server, own

    def close(self) -> None:
        pass


def _plain(op) -> dict:
    ints = lambda x: None if x is None else [int(i) for i in x]
    return {f: ints(op[f]) if f in ("path", "to") else op[f] for f in FIELDS}


def _content(entry: dict) -> list[dict]:
    return [o for o in entry["ops"] if o["op"] not in ALIGNMENT_OPS]


def merge_entries(entries: DataFrame, me: str, policy: str = "manual") -> DataFrame:
    """(doc, chapter, user, sequence, status, ops, pending): what replica ``me`` makes of a stream of entries (doc, chapter, user,
    sequence, layer, ops).

    Own entries (``local``) join what is pending. Others' are taken once each and in the order of their sequence, which counts from
    1 by user: early ones wait, repeated ones are left out. Their operations (alignments aside) are given as they are after the
    pending ones, which are kept as they are after them: ``merged``. Where either side loses an operation to the other it is by
    ``policy`` a ``conflict`` (merged nevertheless, to be looked at), ``kept local`` (nothing is made, all stays pending) or ``took
    remote`` (made as they came; nothing stays pending). Entries of other layers are ``recorded``. pending counts what is left.

    The session has to use the RocksDB store for states (``use_rocks``).
    """
    if policy not in POLICIES:
        raise ValueError(f"policy is none of {POLICIES}")
    return entries.select("doc", "chapter", "user", "sequence", "layer", "ops").groupBy("doc", "chapter").transformWithStateInPandas(Merger(me, policy), MERGED, "append", "none")


def use_rocks(spark) -> None:
    """States of streams that start from now on are kept by RocksDB, which states of several kinds need."""
    spark.conf.set(PROVIDER, ROCKS)


def totals(results: DataFrame) -> DataFrame:
    """(doc, pushed, pulled, conflicts, status): what ``merge_entries`` did, by document: ``conflicts`` where there are any, else ``ok``."""
    n = results.groupBy("doc").agg(F.count_if(F.col("status") == "local").alias("pushed"), F.count_if(F.col("status") != "local").alias("pulled"), F.count_if(F.col("status") == "conflict").alias("conflicts"))
    return n.withColumn("status", F.when(F.col("conflicts") > 0, "conflicts").otherwise("ok"))
