"""Versions of keyed content: differences, three-way merges, operations."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import conflict_id
from quire.operators.markup import by, tokens

#: Operations that add or take away a place, and what they do to later places of the same parent.
SHIFT = {"insertNode": 1, "removeNode": -1}


def changes(local: DataFrame, known: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): new, changed or deleted against the last known digests; equal ones are left out."""
    both = local.select(key, F.col(digest).alias("__l")).join(known.select(key, F.col(digest).alias("__k")), key, "full")
    change = F.when(F.col("__k").isNull(), "new").when(F.col("__l").isNull(), "deleted").when(F.col("__l") != F.col("__k"), "changed")
    return both.select(key, change.alias("change")).where("change IS NOT NULL")


def three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: str, content: str, choose: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """(key, action, content): what a merge makes of each key. Null content counts as absent.

    action is same, ours, theirs (one side changed, added or deleted it, or both alike), or conflict. Of a conflict content is
    ours, or what ``choose`` (base, ours, theirs) makes of it.
    """
    sides = [df.select(key, F.col(content).alias(n)) for df, n in ((base, "b"), (ours, "o"), (theirs, "t"))]
    rows = sides[0].join(sides[1], key, "full").join(sides[2], key, "full")
    b, o, t = F.col("b"), F.col("o"), F.col("t")
    action = F.when(o.eqNullSafe(t) & o.eqNullSafe(b), "same").when(o.eqNullSafe(t) | t.eqNullSafe(b), "ours").when(o.eqNullSafe(b), "theirs").otherwise("conflict")
    made = F.when(F.col("action") == "theirs", t)
    made = made.when(F.col("action") == "conflict", choose(b, o, t)) if choose else made
    return rows.withColumn("action", action).select(key, "action", made.otherwise(o).alias(content))


def diff(old: DataFrame, new: DataFrame, key: list[str], place: str, content: str) -> DataFrame:
    """(key, op, place, content): positional operations that turn old rows into new ones; removals come last to first."""
    both = old.select(*key, place, F.col(content).alias("__o"), F.lit(True).alias("__a")).join(new.select(*key, place, F.col(content).alias("__n"), F.lit(True).alias("__b")), [*key, place], "full")
    op = F.when(F.col("__a").isNull(), "insertNode").when(F.col("__b").isNull(), "removeNode").when(~F.col("__o").eqNullSafe(F.col("__n")), "setText")
    order = F.when(op == "removeNode", -F.col(place)).otherwise(F.col(place))
    return both.select(*key, op.alias("op"), place, F.col("__n").alias(content), order.alias("order")).where("op IS NOT NULL")


def apply_ops(rows: DataFrame, ops: DataFrame, key: list[str], place: str, content: str) -> DataFrame:
    """Rows after their key's operations: sets and removals by place, then insertions in order of place.

    Exact for what ``diff`` makes; places are numbered afresh.
    """
    change = ops.select(*key, place, F.col("op").alias("__op"), F.col(content).alias("__c"))
    both = rows.select(*key, place, content, F.lit(True).alias("__was")).join(change, [*key, place], "full")
    text = F.when(F.col("__op").isin("setText", "insertNode"), F.col("__c")).otherwise(F.col(content))
    left = both.where("__op IS NULL OR __op <> 'removeNode'").select(*key, place, text.alias(content))
    return left.withColumn(place, (F.row_number().over(W.partitionBy(*key).orderBy(place)) - 1).cast("long"))


OP = "op string, path array<int>, to array<int>, attr string, value string, old string"
#: Operations on alignments, which leave the tree alone.
ALIGNMENT_OPS = ("alignWord", "unalignWord", "updateGroup")


def invert(ops: DataFrame, key: list[str], order: str) -> DataFrame:
    """Operations (key, order, op, path, to, attr, value, old) that take others back, in the opposite order.

    value is the new node, text or attribute value, old what it replaces. Removals, replacements and settings whose old
    value is null, and operations on alignments, can't be taken back and are left out.
    """
    op = F.col("op")
    back = F.when(op == "insertNode", "removeNode").when(op == "removeNode", "insertNode").when(op.isin("setText", "setAttr", "replaceNode", "moveNode"), op)
    moved = op == "moveNode"
    rows = ops.where(back.isNotNull() & (op.isin("insertNode", "moveNode") | F.col("old").isNotNull()))
    return rows.select(
        *key, (-F.col(order)).alias(order), back.alias("op"), F.when(moved, F.col("to")).otherwise(F.col("path")).alias("path"),
        F.when(moved, F.col("path")).alias("to"), "attr", F.col("old").alias("value"), F.col("value").alias("old"),
    )


def compose(first: DataFrame, second: DataFrame, key: list[str], order: str) -> DataFrame:
    """One list of operations: those of ``first``, then those of ``second``, numbered from 0 by key."""
    both = first.withColumn("__list", F.lit(0)).unionByName(second.withColumn("__list", F.lit(1)))
    place = F.row_number().over(W.partitionBy(*key).orderBy("__list", order)) - 1
    return both.withColumn(order, place.cast(dict(first.dtypes)[order])).drop("__list")


def by_chapter(ops: DataFrame, key: list[str], order: str) -> DataFrame:
    """(key, ops): each key's operations in order, as an array."""
    item = F.struct(order, *[c for c in ops.columns if c not in (*key, order)])
    return ops.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("ops"))


#: What ``transform`` folds: a chapter's operations as an array.
_OPS = "array<struct<seq: long, op: string, path: array<int>, to: array<int>, attr: string, value: string, old: string>>"


def transform(mine: DataFrame, prior: DataFrame, key: list[str]) -> DataFrame:
    """Operations (key, seq, op, path, to, attr, value, old) of ``mine`` as they are after those of ``prior`` were made first.

    Insertions and removals shift later places below the same parent. Dropped are those at or below what others
    replaced, and settings of the same attribute; a text that others set first is the old text of one's own. A move counts
    as a removal and an insertion. The key is a chapter, whose operations are few; they are folded in order, since each
    shift depends on the place reached so far, in Arrow batches of chapters.
    """
    names = ["seq", "op", "path", "to", "attr", "value", "old"]

    @F.pandas_udf(_OPS)
    def fold(own: pd.Series, others: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(own, others, strict=True):
            left = []
            for op in a:
                for p in () if b is None else b:
                    op = None if op is None else _after(p, op)
                left += [op] if op is not None else []
            out.append(left)
        return pd.Series(out)

    listed = lambda ops, name: ops.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*names))).alias(name))
    both = listed(mine, "__own").join(listed(prior.select(*key, *names), "__others"), key, "left")
    made = both.select(*key, F.explode(fold("__own", "__others")).alias("o"))
    return made.select(*key, *[F.col(f"o.{n}").cast(dict(mine.dtypes)[n]).alias(n) for n in names])


def transform_lists(ours: DataFrame, theirs: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both lists, each after the other."""
    return transform(ours, theirs, key), transform(theirs, ours, key)


def _list(path) -> list[int]:
    return [] if path is None else list(map(int, path))


def _shifted(path: list[int], at: list[int], by: int) -> list[int]:
    """A path after an insertion (by 1) or removal (by -1) at ``at``, if that has the same parent."""
    if not at or len(path) != len(at) or path[:-1] != at[:-1]:
        return path
    hit = path[-1] >= at[-1] if by > 0 else path[-1] > at[-1]
    return [*path[:-1], path[-1] + by * hit]


def _after(prior: dict, op: dict) -> dict | None:
    """``op`` once ``prior`` was made; None if nothing is left of it."""
    first, kind = prior["op"], op["op"]
    if first in ALIGNMENT_OPS or kind in ALIGNMENT_OPS:
        return op
    at, path, to = _list(prior["path"]), _list(op["path"]), _list(op["to"])
    if first == "moveNode":
        op = _after({"op": "removeNode", "path": at}, op)
        return _after({"op": "insertNode", "path": _list(prior["to"])}, op)
    if first in SHIFT:
        return op | {"path": _shifted(path, at, SHIFT[first]), "to": _shifted(to, at, SHIFT[first]) if kind == "moveNode" else op["to"]}
    if first == kind == "setText" and at == path:
        return op | {"old": prior["value"]}
    if first == kind == "setAttr" and at == path and prior["attr"] == op["attr"]:
        return None
    if first == "replaceNode" and (path[: len(at)] == at or kind == "moveNode" and to[: len(at)] == at):
        return None
    return op


def overlaps(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Pairs of operations on the same chapter and the same first two places of their paths (short paths meet all)."""
    x = a.select(*key, F.col("op_id").alias("a_id"), F.col("path").alias("a_path"))
    y = b.select(*key, F.col("op_id").alias("b_id"), F.col("path").alias("b_path"))
    short = lambda path: F.coalesce(F.size(path) < 2, F.lit(False))
    x, y = x.withColumn("short", short("a_path")), y.withColumn("short", short("b_path"))
    names = [*key, "a_id", "b_id"]
    first = lambda path: F.slice(path, 1, 2).alias("first")
    same = x.where("NOT short").select("*", first("a_path")).join(y.where("NOT short").select("*", first("b_path")), [*key, "first"]).select(names)
    a_short, b_short = x.where("short").join(y, key).select(names), x.where("NOT short").join(y.where("short"), key).select(names)
    return same.unionByName(a_short).unionByName(b_short)


def _cells(files: DataFrame, key: str, side: str) -> DataFrame:
    """(key, chapter, block, cell, kind, piece) of one side's tagged text: its markers with their text, by chapter, paragraph
    and place in the paragraph. kind is the paragraph's marker, null but for the first cell."""
    rows = tokens(files.select(key, side), key, side)
    opens = ~F.col("closing")
    chapter = F.when((F.col("marker") == "c") & opens, F.coalesce(F.regexp_extract("raw", r"^\s*(\d+)", 1).try_cast("int"), F.lit(0)))
    # a paragraph is a marker that opens a line and isn't a verse
    breaks = F.coalesce(F.lag("raw").over(W.partitionBy(*by(rows, key)).orderBy("pos")).rlike(r"\n\s*$"), F.lit(True)) & opens & (F.col("marker") != "v") & ~F.col("marker").rlike("^(w|f|x|zaln-[se])$")
    upto = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({"chapter": F.coalesce(F.last(chapter, ignorenulls=True).over(upto), F.lit(0)), "__breaks": breaks})
    inside = W.partitionBy(key, "chapter").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("block", F.count_if("__breaks").over(inside))
    cell = F.row_number().over(W.partitionBy(key, "chapter", "block").orderBy("pos")) - 1
    piece = F.concat(F.lit("\\"), F.when(F.col("nested"), "+").otherwise(""), "marker", F.when(F.col("closing"), "*").otherwise(""), "raw")
    return rows.select(key, "chapter", "block", cell.alias("cell"), F.when(F.col("__breaks"), F.col("marker")).alias("kind"), piece.alias("piece"))


def merge_tagged(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, kind, text, chapters) from three versions (key, base, ours, theirs) of tagged files.

    Each side's differences from the base are found by chapter, paragraph and place. Where both sides change the same place of
    a chapter, or one adds, removes or exchanges a paragraph in a chapter that the other changes at all, the file is a conflict
    (text is null, chapters are 0, which stands for the file, and those changed by either side); else both sides' changes are made.
    """
    on = [key, "chapter", "block", "cell"]
    sides = [_cells(files, key, c).withColumnsRenamed({"kind": f"k_{c}", "piece": c}) for c in ("base", "ours", "theirs")]
    rows = sides[0].join(sides[1], on, "full").join(sides[2], on, "full")
    differs = lambda c: ~F.col(c).eqNullSafe(F.col("base"))
    whole = lambda c: (F.col("cell") == 0) & differs(c) & ~F.col(f"k_{c}").eqNullSafe(F.col("k_base"))
    both = differs("ours") & differs("theirs")
    chapters = rows.groupBy(key, "chapter").agg(*[F.bool_or(f(c)).alias(f"{n}_{c}") for n, f in (("any", differs), ("whole", whole)) for c in ("ours", "theirs")], F.bool_or(both).alias("both"))
    clash = F.col("both") | (F.col("whole_ours") & F.col("any_theirs")) | (F.col("whole_theirs") & F.col("any_ours"))
    changed = F.col("any_ours") | F.col("any_theirs")
    judged = chapters.groupBy(key).agg(F.bool_or(clash).alias("bad"), F.array_sort(F.array_union(F.array(F.lit(0)), F.collect_set(F.when(changed, F.col("chapter"))))).alias("chapters"))
    merged = rows.withColumn("piece", F.when(differs("ours"), F.col("ours")).otherwise(F.col("theirs"))).where("piece IS NOT NULL")
    parts = F.array_sort(F.collect_list(F.struct("chapter", "block", "cell", "piece")))
    texts = merged.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["piece"]), "").alias("text"))
    out = files.select(key).join(judged, key, "left").join(texts, key, "left")
    bad = F.coalesce("bad", F.lit(False))
    return out.select(key, F.when(bad, "conflict").otherwise("merged").alias("kind"), F.when(~bad, F.coalesce("text", F.lit(""))).alias("text"), F.when(bad, F.col("chapters")).alias("chapters"))


#: Endings of files that are text.
TEXT_ENDINGS = ("md", "yaml", "yml", "json", "jsonl", "usfm", "sfm", "txt", "tsv", "css", "html")


def file_kind(path: Column) -> Column:
    """How a file is merged: journal, tagged, text, or binary (an ending that isn't known)."""
    name = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    ending = F.regexp_extract(name, r"\.([^.]*)$", 1)
    journal = F.startswith(name, F.lit("journal/")) & (ending == "jsonl")
    binary = F.contains(name, F.lit(".")) & ~ending.isin(*TEXT_ENDINGS)
    return F.when(journal, "journal").when(binary, "binary").when(ending.isin("usfm", "sfm"), "tagged").otherwise("text")


def _json(text: Column) -> Column:
    """JSON objects and arrays without white space between tokens; null for other text."""
    bare = F.regexp_replace(text, r'("(?:[^"\\]|\\.)*")|\s+', "$1")
    return F.when(F.try_parse_json(text).isNotNull() & bare.rlike(r"^[\[{]"), bare)


def merge_journals(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, kind, text, chapters) from three versions of files with one JSON entry a line: entries are merged by id, in the
    order of ours and then theirs; an id that both sides change differently is a conflict."""
    sides = []
    for n in ("base", "ours", "theirs"):
        line = files.select(key, F.posexplode(F.split(n, r"\r?\n")).alias("pos", "line")).where("trim(line) <> ''")
        ident = F.coalesce(F.get_json_object("line", "$.id"), F.when(F.get_json_object("line", "$._journalHeader").isNotNull(), "header"), F.md5("line"))
        sides.append(line.groupBy(key, ident.alias("id")).agg(F.max_by("line", "pos").alias(n), F.max("pos").alias(f"pos_{n}")))
    rows = sides[0].join(sides[1], [key, "id"], "full").join(sides[2], [key, "id"], "full")
    o, t, b = F.col("ours"), F.col("theirs"), F.col("base")
    clash = ~o.eqNullSafe(t) & ~o.eqNullSafe(b) & ~t.eqNullSafe(b)
    line = F.when(o.eqNullSafe(b), t).otherwise(o)
    order = F.struct(F.col("pos_ours").isNull().alias("n"), F.coalesce("pos_ours", "pos_theirs").alias("pos"), line.alias("line"))
    made = rows.groupBy(key).agg(F.bool_or(clash).alias("bad"), F.array_sort(F.collect_list(F.when(line.isNotNull(), order))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: F.concat(x["line"], F.lit("\n"))), "")
    return files.select(key).join(made, key, "left").select(key, F.when(F.col("bad"), "conflict").otherwise("merged").alias("kind"), F.when(~F.coalesce("bad", F.lit(False)), F.coalesce(text, F.lit(""))).alias("text"), F.when(F.col("bad"), F.array().cast("array<int>")).alias("chapters"))


def merge_files(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, kind, text, conflict) from three versions (key, base, ours, theirs) of files; null where a version hasn't the file.

    A side that equals another or the base gives way to the change. A file that one side has taken away is ``deleted`` if the
    other left it as it was, a conflict if the other changed it, and taken over if only one side ever had it; one that both have
    taken away has no row. Of files that all sides have, or that both have made, tagged ones and journals are merged by content,
    JSON files if the versions differ in white space alone; all else that both sides change is a conflict, with its id.
    """
    b, o, t = F.col("base"), F.col("ours"), F.col("theirs")
    absent = o.isNull() | t.isNull()
    kind = F.when(absent & b.isNull(), "merged").when(absent & (F.coalesce(o, t) == b), "deleted").when(absent, "conflict")
    rows = files.where("ours IS NOT NULL OR theirs IS NOT NULL").withColumns({"__kind": kind, "__side": F.when(absent & b.isNull(), F.coalesce(o, t))})
    rows = rows.withColumns({"base": F.coalesce(b, F.lit("")), "ours": F.coalesce(o, F.lit("")), "theirs": F.coalesce(t, F.lit(""))})
    easy = F.when(o == t, o).when(b == o, t).when(b == t, o)
    jb, jo, jt = _json(b), _json(o), _json(t)
    parsed = jb.isNotNull() & jo.isNotNull() & jt.isNotNull()
    easy = easy.when((file_kind(F.col(key)) == "text") & parsed & ((jo == jt) | (jb == jt)), o).when((file_kind(F.col(key)) == "text") & parsed & (jb == jo), t)
    rows = rows.withColumns({"__easy": F.when(F.col("__kind").isNull(), easy).otherwise(F.col("__side")), "__way": F.when(F.col("__kind").isNull(), file_kind(F.col(key)))})
    hard = rows.where("__easy IS NULL").select(key, "base", "ours", "theirs", "__way")
    made = merge_tagged(hard.where("__way = 'tagged'"), key).unionByName(merge_journals(hard.where("__way = 'journal'"), key))
    out = rows.join(made.withColumnRenamed("text", "__text"), key, "left")
    text = F.coalesce("__easy", "__text")
    kind = F.coalesce("__kind", F.when(text.isNull(), "conflict").otherwise("merged"))
    conflict = F.when(kind == "conflict", conflict_id(F.col(key), F.coalesce("chapters", F.array().cast("array<int>")), o, t))
    return out.select(key, kind.alias("kind"), text.alias("text"), conflict.alias("conflict"))


def edit_chapters(rows: DataFrame, key: str, new: DataFrame | None = None, gone: DataFrame | None = None, moves: DataFrame | None = None, add: bool = False) -> DataFrame:
    """Rows (key, chapter, place, content) after ``replace_chapters`` with ``new``, ``delete_chapters`` with ``gone`` and
    ``renumber_chapters`` with ``moves``, in this order, each where given.

    What is to be done goes along with the rows, dealt by book once and put in order of chapters once.
    """
    names = rows.columns
    kind = dict(rows.dtypes)["chapter"]
    named = F.col(key).isNotNull() & F.col("chapter").isNotNull()
    row, put, cut, move = range(4)
    mark = lambda df, what: df.withColumn("__what", F.lit(what).cast("byte"))
    of = lambda what: F.col("__what") == what
    parts = [mark(rows, row)]
    if new is not None:
        parts.append(mark((new if add else new.where(named)).select(names), put))
    if gone is not None:
        parts.append(mark(gone.where(named).select(key, "chapter"), cut))
    if moves is not None:
        good = moves.where(named & F.expr("chapter >= 1 AND new >= 1"))
        parts.append(mark(good.select(key, F.col("chapter").cast(kind).alias("chapter"), F.col("new").alias("__new")), move))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    if moves is not None:
        out = out.repartition(key)
    w = W.partitionBy(key, "chapter")
    some = lambda what: F.coalesce(F.max(of(what)).over(w), F.lit(False)) & named
    stays = (of(row) & ~some(put) | of(put) & (F.lit(add) | some(row))) & ~some(cut)
    out = out.withColumn("__stays", stays)
    if moves is None:
        return out.where("__stays").select(names)
    # numbers that are taken, of all chapters of the book
    taken = F.collect_set(F.when(F.col("__stays"), F.col("chapter"))).over(W.partitionBy(key))
    to = F.filter(F.collect_list("__new").over(w), lambda n: ~F.array_contains("__taken", n))
    out = out.withColumn("__taken", taken).withColumn("__to", F.when(named, to)).where("__stays")
    return out.withColumn("__to", F.explode_outer("__to")).withColumn("chapter", F.coalesce("__to", "chapter")).select(names)


def replace_chapters(rows: DataFrame, new: DataFrame, key: str, add: bool = False) -> DataFrame:
    """Rows (key, chapter, place, content) with the chapters of ``new`` in place of theirs; chapters that a book doesn't have
    are put in by number if ``add``, else left out."""
    return edit_chapters(rows, key, new=new, add=add)


def delete_chapters(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows without the chapters of ``gone`` (key, chapter)."""
    return edit_chapters(rows, key, gone=gone)


def merge_into_previous(rows: DataFrame, chapters: DataFrame, key: str) -> DataFrame:
    """Rows with chapters of ``chapters`` (key, chapter) added to the end of the chapter before, without their first row (the
    chapter marker). Chapter 0 and first chapters stay. Places are numbered afresh."""
    before = rows.select(key, "chapter").distinct().withColumn("__before", F.lag("chapter").over(W.partitionBy(key).orderBy("chapter")))
    marked = before.join(chapters.select(key, "chapter").distinct().withColumn("__on", F.lit(True)), [key, "chapter"], "left")
    goes = F.coalesce("__on", F.lit(False)) & (F.col("chapter") > 0) & F.col("__before").isNotNull()
    # several chapters in a row all go to the one before the first of them
    stays = F.last(F.when(~goes, F.col("chapter")), ignorenulls=True).over(W.partitionBy(key).orderBy("chapter").rowsBetween(W.unboundedPreceding, 0))
    to = marked.select(key, "chapter", stays.alias("__to"), goes.alias("__goes"))
    first = F.row_number().over(W.partitionBy(key, "chapter").orderBy("place")) == 1
    out = rows.join(to, [key, "chapter"]).withColumn("__first", first).where("NOT (__goes AND __first)")
    place = F.row_number().over(W.partitionBy(key, "__to").orderBy("chapter", "place")) - 1
    return out.withColumn("place", place.cast(dict(rows.dtypes)["place"])).withColumn("chapter", F.col("__to")).select(rows.columns)


def renumber_chapters(rows: DataFrame, moves: DataFrame, key: str) -> DataFrame:
    """Rows with chapters renumbered by ``moves`` (key, chapter, new): those that exist, to numbers from 1 that aren't taken."""
    return edit_chapters(rows, key, moves=moves)


def edit_verses(rows: DataFrame, edits: DataFrame, key: list[str], content: str) -> DataFrame:
    """Rows with the content of ``edits`` (key, content) where there is one for their verse."""
    new = edits.select(*key, F.col(content).alias("__new"))
    return rows.join(new, key, "left").withColumn(content, F.coalesce("__new", content)).drop("__new")
