"""Operations on trees: differences between two versions, and lists of operations applied by chapter.

A tree is a table of nodes (key, path, name, attrs, text, holds): path leads from the root of a chapter by places among siblings;
a text has a text and no name; holds says that a node has a list of content, be it empty. The key may have several columns.

Operations never meet the nodes in Python. What a chapter's operations do to its lists of siblings is worked out from the
operations and the lengths of the lists alone: a list is a few runs of old places, new nodes between them, and each
insertion, removal or move cuts and shifts runs. What comes out is a table of runs, from old places to new ones, which nodes
find by the deepest list on their path that was touched.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators.trees import ancestors

NODE = "name string, attrs map<string,string>, text string, holds boolean"
#: What an operation puts in: a subtree with paths from its root, whose own path is empty.
SUBTREE = "array<struct<path:array<int>,name:string,attrs:map<string,string>,text:string,holds:boolean>>"
#: Attributes that no operation may set (they would reach into the objects of other readers of the same operations).
UNSAFE = ("__proto__", "constructor", "prototype")


def with_paths(tree: DataFrame, key: str) -> DataFrame:
    """A tree table with ``nested_sets`` (key, pos, level, idx, ...) with each node's path of places."""
    up = ancestors(tree, key, F.col("idx")).groupBy(key, "pos").agg(F.array_sort(F.collect_list(F.struct("above", F.col("mark").cast("int").alias("idx")))).alias("__up"))
    above = F.coalesce(F.transform("__up", lambda x: x["idx"]), F.array().cast("array<int>"))
    return tree.join(up, [key, "pos"], "left").withColumn("path", F.concat(above, F.array(F.col("idx").cast("int")))).drop("__up")


class _New:
    """A node that an operation has put in."""

    def __init__(self, rows) -> None:
        rows = sorted(((tuple(r["path"]), r) for r in rows), key=lambda x: x[0])
        self.name, self.attrs, self.text, holds = self._of(rows[0][1])
        self.content = [] if holds else None
        below = defaultdict(list)
        for path, r in rows[1:]:
            below[path[0]].append({**r, "path": path[1:]})
        for i in sorted(below):
            self.content.append(_New(below[i]))

    @staticmethod
    def _of(r) -> tuple:
        return r["name"], dict(r["attrs"] or {}), r["text"], bool(r["holds"])


class _Lists:
    """The lists of one chapter: of entries that are new nodes or runs (list, from, to) of old places."""

    def __init__(self, counts: dict[tuple, int]) -> None:
        self.counts, self.of, self.settings = counts, {}, []
        self.root = self.old(())

    def old(self, path: tuple) -> list | None:
        """The list that an old node holds, None if it holds none."""
        if path not in self.of:
            if path not in self.counts:
                return None
            self.of[path] = [(path, 0, self.counts[path])] if self.counts[path] else []
        return self.of[path]

    @staticmethod
    def size(entry) -> int:
        return 1 if isinstance(entry, _New) else entry[2] - entry[1]

    def cut(self, entries: list, at: int) -> int | None:
        """The number of the entry that begins at a place, after cutting a run there; None beyond the end."""
        for k, entry in enumerate(entries):
            if at == 0:
                return k
            n = self.size(entry)
            if at < n:
                path, lo, hi = entry
                entries[k : k + 1] = [(path, lo, lo + at), (path, lo + at, hi)]
                return k + 1
            at -= n
        return len(entries) if at == 0 else None

    def holder(self, path: list[int]) -> list | None:
        """The list that the last place of a path is one of."""
        entries = self.root
        for step in path[:-1]:
            item = self.item(entries, step)
            entries = item.content if isinstance(item, _New) else None if item is None else self.old(item)
            if entries is None:
                return None
        return entries if path else None

    def item(self, entries: list, at: int) -> _New | tuple | None:
        """What stands at a place: a new node, or the path of an old one."""
        for entry in entries:
            n = self.size(entry)
            if at < n:
                return entry if isinstance(entry, _New) else (*entry[0], entry[1] + at)
            at -= n
        return None

    def take(self, path: list[int]) -> list:
        """Takes the node at a path out: a list of its entry, empty if there is none."""
        entries = self.holder(path)
        if entries is None or self.item(entries, path[-1]) is None:
            return []
        k = self.cut(entries, path[-1])
        self.cut(entries, path[-1] + 1)
        return [entries.pop(k)]

    def put(self, path: list[int], made: list, appended: bool = True) -> None:
        """Puts entries at a place; beyond the end they are appended, or left out."""
        entries = self.holder(path)
        if entries is not None:
            k = self.cut(entries, path[-1])
            k = len(entries) if k is None and appended else k
            if k is not None:
                entries[k:k] = made

    def apply(self, op: dict) -> None:
        kind, path = op["op"], op["path"]
        if not path:
            return
        if kind == "insertNode":
            self.put(path, [_New(op["node"])])
        elif kind == "removeNode":
            self.take(path)
        elif kind in ("replaceNode", "setText"):
            self.take(path)
            self.put(path, [_New(op["node"] if kind == "replaceNode" else [{"path": (), "name": None, "attrs": None, "text": op["value"], "holds": False}])], appended=False)
        elif kind == "moveNode" and op["to"]:
            if moved := self.take(path):
                self.put(op["to"], moved)
        elif kind == "setAttr" and op["attr"] not in UNSAFE:
            entries = self.holder(path)
            item = None if entries is None else self.item(entries, path[-1])
            if isinstance(item, _New) and item.name is not None:
                item.attrs = {k: v for k, v in {**item.attrs, op["attr"]: op["value"]}.items() if v is not None}
            elif isinstance(item, tuple):
                self.settings.append((item, op["attr"], op["value"]))

    def result(self) -> list[tuple]:
        """Rows (kind, list, lo, hi, parent, shift, node): run (parent is null for places that are gone), new, set."""
        out, placed, owners = [], defaultdict(list), defaultdict(list)
        for path in self.of:
            if path:
                owners[path[:-1]].append(path[-1])

        def walk(entries: list, parent: tuple) -> None:
            j = 0
            for entry in entries:
                if isinstance(entry, _New):
                    out.append(("new", (*parent, j), None, None, None, None, (entry.name, entry.attrs, entry.text, entry.content is not None)))
                    walk(entry.content or [], (*parent, j))
                else:
                    path, lo, hi = entry
                    out.append(("run", path, lo, hi, parent, j - lo, None))
                    placed[path].append((lo, hi))
                    for i in owners[path]:
                        if lo <= i < hi:
                            walk(self.of[(*path, i)], (*parent, j + i - lo))
                j += self.size(entry)

        walk(self.root, ())
        for path in self.of:
            at = 0
            for lo, hi in [*sorted(placed[path]), (self.counts[path],) * 2]:
                if at < lo:
                    out.append(("run", path, at, lo, None, None, None))
                at = hi
        return out + [("set", path, n, n, None, None, (attr, {attr: value} if value is not None else {}, None, False)) for n, (path, attr, value) in enumerate(self.settings)]


#: What ``_Lists.result`` gives, with the number of the chapter's row first.
_RESULT = [("__row", pa.int64()), ("kind", pa.string()), ("list", pa.list_(pa.int32())), ("lo", pa.int64()), ("hi", pa.int64()), ("parent", pa.list_(pa.int32())), ("shift", pa.int64())]
_RESULT += [("name", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("holds", pa.bool_())]


#: Chapters whose operations are Python objects at once.
CHAPTERS = 50


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The results of chapters (key, ops, counts), a row each, some chapters at a time: a batch may hold ten thousand."""
    for b in (whole.slice(at, CHAPTERS) for whole in batches for at in range(0, whole.num_rows, CHAPTERS)):
        rows = []
        for i, (ops, counts) in enumerate(zip(b.column("ops"), b.column("counts"), strict=True)):
            lists = _Lists({(): 0} | {tuple(c["list"]): c["n"] for c in counts.as_py() or []})
            for op in sorted(ops.as_py(), key=lambda o: o["seq"]):
                lists.apply(op)
            rows += [(i, kind, path, lo, hi, parent, shift, *((node[0], list(node[1].items()), *node[2:]) if node else (None,) * 4)) for kind, path, lo, hi, parent, shift, node in lists.result()]
        made = [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(_RESULT)]
        keys = [c for c in b.schema.names if c not in ("ops", "counts")]
        yield pa.RecordBatch.from_arrays([*[b.column(k).take(made[0]) for k in keys], *made[1:]], [*keys, *[n for n, _ in _RESULT[1:]]])


def apply_tree_ops(nodes: DataFrame, ops: DataFrame, key: list[str]) -> DataFrame:
    """Nodes (key, path, name, attrs, text, holds) after the operations (key, seq, op, path, to, attr, value, node) of their chapter, in
    order of seq.

    insertNode, removeNode, replaceNode (``node`` is a subtree), setText (``value`` takes the node's place), setAttr (a null value
    takes the attribute away) and moveNode (``to`` is a place after the node was taken out). Paths are as the operations before have
    left them. An insertion beyond the end is appended, replacing just beyond the end appends; what leads nowhere does nothing, as
    do all other operations. Chapters without operations stay; operations on chapters without nodes make new ones. Keys
    aren't null.
    """
    names = ["name", "attrs", "text", "holds"]
    # dealt by chapter once: what follows asks for no other order of rows among tasks
    mine = nodes.select(*key, "path", *names).repartition(*key)
    own = F.struct(F.slice("path", 1, F.size("path") - 1).alias("list"), F.lit(1).alias("n"))
    held = F.when(F.col("holds"), F.array(own, F.struct(F.col("path").alias("list"), F.lit(0).alias("n")))).otherwise(F.array(own))
    counts = mine.select(*key, F.explode(held).alias("c")).groupBy(*key, "c.list").agg(F.sum("c.n").alias("n"))
    counted = counts.select(*key, F.struct("list", F.col("n").cast("long").alias("n")).alias("counts"))
    listed = ops.select(*key, F.struct("seq", "op", "path", "to", "attr", "value", "node").alias("ops")).unionByName(counted, allowMissingColumns=True)
    listed = listed.groupBy(*key).agg(F.collect_list("ops").alias("ops"), F.collect_list("counts").alias("counts")).where("size(ops) > 0")
    kinds = dict(nodes.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in key) + f", kind string, list array<int>, lo long, hi long, parent array<int>, shift long, {NODE}"
    made = listed.mapInArrow(_folded, schema).where("kind <> 'run' OR hi > lo").repartition(*key)
    # each node stands in every list on its path, a run where it begins; the node itself goes along with the deepest list
    deep = F.greatest(F.size("path"), F.lit(1))
    steps = mine.withColumn("__k", F.explode(F.sequence(F.lit(1), deep)))
    steps = steps.select(*key, F.lit(False).alias("__fresh"), "path", "__k", F.slice("path", 1, F.col("__k") - 1).alias("__list"), F.get("path", F.col("__k") - 1).cast("long").alias("__i"), F.when(F.col("__k") == deep, F.struct(*names)).alias("__node"))
    of = lambda kind, c, name: F.when(F.col("kind") == kind, c).alias(name)
    setting = F.struct(F.col("lo").alias("n"), F.col("name").alias("attr"), F.try_element_at("attrs", F.col("name")).alias("value"))
    found = made.select(*key, (F.col("kind") == "new").alias("__fresh"), F.when(F.col("kind") != "run", F.col("list")).alias("path"), of("run", F.col("list"), "__list"), of("run", F.col("lo"), "__i"), of("run", F.struct("hi", "parent", "shift"), "__run"), of("set", setting, "__set"), of("new", F.struct(*names), "__node"))
    w = W.partitionBy(*key, "__list").orderBy("__i", F.col("__run").isNull()).rowsBetween(W.unboundedPreceding, 0)
    rows = steps.unionByName(found, allowMissingColumns=True).withColumn("__last", F.last("__run", ignorenulls=True).over(w)).where("__run IS NULL")
    # each node by the deepest touched list on its path
    to = F.when(F.col("__i") < F.col("__last.hi"), F.struct(F.col("__last.parent").alias("parent"), (F.col("__i") + F.col("__last.shift")).cast("int").alias("place"), F.col("__k").alias("k")))
    rows = rows.select(*key, "__fresh", "path", "__node", "__set", to.alias("__to"))
    node = W.partitionBy(*key, "__fresh", "path")
    rows = rows.withColumns({"__to": F.max_by("__to", "__to.k").over(node), "__sets": F.array_sort(F.collect_list("__set").over(node))}).where("__node IS NOT NULL AND (__to IS NULL OR __to.parent IS NOT NULL)")
    path = F.when(F.col("__to").isNotNull(), F.concat("__to.parent", F.array("__to.place"), F.slice("path", F.col("__to.k") + 1, F.size("path")))).otherwise(F.col("path"))
    # the last setting of an attribute holds
    last = F.map_from_entries(F.aggregate("__sets", F.array().cast("array<struct<attr:string,value:string>>"), lambda s, x: F.concat(F.filter(s, lambda e: e["attr"] != x["attr"]), F.array(F.struct(x["attr"].alias("attr"), x["value"].alias("value"))))))
    kept = F.map_filter("__node.attrs", lambda k, v: ~F.map_contains_key(last, k))
    attrs = F.when((F.size("__sets") > 0) & F.col("__node.name").isNotNull(), F.map_concat(kept, F.map_filter(last, lambda k, v: v.isNotNull()))).otherwise(F.col("__node.attrs"))
    return rows.select(*key, path.alias("path"), "__node.name", attrs.alias("attrs"), "__node.text", "__node.holds")


def diff_trees(old: DataFrame, new: DataFrame, key: list[str], chapter: str) -> DataFrame:
    """(key, chapter, seq, op, path, to, attr, value, node): operations that turn the chapters of ``old`` into those of ``new``, for
    chapters that both have. ``key`` has the columns before the chapter.

    Nodes are compared place by place. Where both sides hold lists under the same name the lists are compared and attributes are not;
    two different texts give setText, other differing nodes replaceNode, further nodes at the end insertNode and removeNode. In the
    order of seq removals come last, from the end.
    """
    on = [*key, chapter]
    names = ["name", "attrs", "text", "holds"]
    # dealt by chapter once; everything else follows from the order of paths in a chapter, where a subtree is an interval
    side = lambda df, c: df.select(*on, "path", *names).repartition(*on).select(*on, "path", F.struct(*names).alias(c))
    one = lambda c: F.first(c, ignorenulls=True).alias(c)
    rows = side(old, "a").unionByName(side(new, "b"), allowMissingColumns=True).groupBy(*on, "path").agg(one("a"), one("b"))
    a, b = F.col("a"), F.col("b")
    there = a.isNotNull() & b.isNotNull()
    inside = F.coalesce(there & a["holds"] & b["holds"] & (a["name"] == b["name"]), F.lit(False))
    entries = lambda m: F.array_sort(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))))
    equal = a["name"].eqNullSafe(b["name"]) & a["text"].eqNullSafe(b["text"]) & (entries(a["attrs"]) == entries(b["attrs"])) & (a["holds"] == b["holds"])
    op = F.when(a.isNull(), "insertNode").when(b.isNull(), "removeNode").when(inside | equal, None).when(a["text"].isNotNull() & b["text"].isNotNull(), "setText").otherwise("replaceNode")
    whole = W.partitionBy(*on)
    order = whole.orderBy("path")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    both = F.max(a.isNotNull()).over(whole) & F.max(b.isNotNull()).over(whole)
    for k in on:
        both = both & F.col(k).isNotNull()
    judged = rows.withColumn("__both", both).withColumn("op", F.when(F.col("__both"), op))
    # what lies below a node that goes or comes as a whole needs no operation of its own
    root = F.col("op").isin("insertNode", "removeNode", "replaceNode")
    beyond = F.when(root & (F.size("path") > 0), F.concat(F.slice("path", 1, F.size("path") - 1), F.array(F.element_at("path", -1) + 1)))
    judged = judged.withColumn("__beyond", beyond)
    below = F.coalesce(F.max("__beyond").over(order.rowsBetween(W.unboundedPreceding, -1)) > F.col("path"), F.lit(False))
    judged = judged.withColumn("__below", below).withColumn("__op", F.when(~F.col("__below"), F.col("op")))
    gone = F.coalesce(F.col("__op") == "removeNode", F.lit(False))
    stays = F.col("__op").isNotNull() & ~gone
    count = lambda c, over: F.count_if(c).over(over)
    seq = F.when(gone, count(stays, whole) + count(gone, whole) - count(gone, upto)).when(stays, count(stays, upto) - 1)
    above = F.last(F.when(F.col("__op").isin("insertNode", "removeNode", "replaceNode"), F.struct("path", "op")), ignorenulls=True).over(upto)
    found = judged.withColumns({"seq": seq, "__root": above})
    found = found.withColumn("__at", F.when(F.col("__below"), F.col("__root.path")).otherwise(F.col("path")))
    comes = F.when(F.col("__below"), F.col("__root.op")).otherwise(F.col("op")).isin("insertNode", "replaceNode") & b.isNotNull()
    relative = F.slice("path", F.size("__at") + 1, F.size("path"))
    part = F.when(comes, F.struct(relative.alias("path"), *[b[c].alias(c) for c in names]))
    found = found.withColumn("__part", part).where("__op IS NOT NULL OR __below AND __part IS NOT NULL")
    value = F.when(F.col("__op") == "setText", b["text"])
    found = found.groupBy(*on, "__at").agg(F.max("seq").alias("seq"), F.max("__op").alias("op"), F.max(value).alias("value"), F.collect_list("__part").alias("node"))
    none = F.lit(None)
    return found.select(*on, F.col("seq").cast("long").alias("seq"), "op", F.col("__at").alias("path"), none.cast("array<int>").alias("to"), none.cast("string").alias("attr"), "value", F.when(F.size("node") > 0, F.col("node")).cast(SUBTREE).alias("node"))


def hydrate_trees(snapshot: DataFrame, entries: DataFrame, key: list[str], clock: DataFrame | None = None) -> DataFrame:
    """The nodes of a snapshot after the operations of a journal's entries (key, user, sequence, ops), in order of sequence and user.

    ops: array of structs as ``apply_tree_ops`` takes them. ``clock`` (user, sequence) says what the snapshot already has of
    each user; entries that come twice count once. So replicas that got the same entries in any order come to the same nodes.
    """
    rows = entries.dropDuplicates([*key, "user", "sequence"])
    if clock is not None:
        known = clock.select("user", F.col("sequence").alias("__known"))
        rows = rows.join(known, "user", "left").where("sequence > coalesce(__known, -1)").drop("__known")
    ops = rows.select(*key, "user", "sequence", F.posexplode("ops").alias("__n", "o"))
    seq = F.row_number().over(W.partitionBy(*key).orderBy("sequence", "user", "__n")).cast("long")
    return apply_tree_ops(snapshot, ops.select(*key, seq.alias("seq"), "o.*"), key)
