"""Trees as tables: nodes in document order with their level, and what follows from these two by windows.

A tree table has one row a node: the document's key, ``pos`` (numbers in document order) and ``level`` (roots have 0). The parent
of a node is the nearest node before it that is one level higher up; a node ends before the next one that isn't deeper. Both are
windows by (key, level), so no task walks a tree. Trees come from XML by a lexer of
column expressions, or from JSON, and go to tagged text as ordered pieces.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import unescape_xml


def nested_sets(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (key, pos, level, ...) with parent (pos of the parent, null for roots), idx (from 0 among siblings) and last (pos of
    the last node below, or its own): the interval from pos to last holds a node's subtree.

    A level is at most one more than that of the node before, and a document starts with level 0. pos is unique in a document.
    Columns named parent, idx and last are replaced.
    """
    names = [c for c in rows.columns if c not in (key, "level", "parent", "idx", "last")]
    doc = W.partitionBy(key)
    order = doc.orderBy("pos")
    level = F.col("level").cast("int")
    seen = rows.select(key, F.struct(*names).alias("__row"), "pos", level.alias("level"), F.lag(level).over(order).alias("__above"), F.lag("pos").over(order).alias("__before"), F.lead(level).over(order).alias("__below"), F.max("pos").over(doc).alias("__end"))
    # a node stands in its own level, and as an end in those of the open nodes that are deeper, but for the node just before it: nothing
    # is below that one
    deeper = F.when(F.col("__above") > F.col("level") + 1, F.sequence(F.col("level") + 1, F.col("__above") - 1))
    places = F.concat(F.array("level"), F.coalesce(deeper, F.array().cast("array<int>")))
    own = F.col("__at") == F.col("level")
    events = seen.withColumn("__at", F.explode(places)).select(key, "pos", F.col("__at").alias("level"), "__before", F.when(own, F.col("__above")).alias("__above"), F.when(own, F.col("__below")).alias("__below"), F.when(own, F.col("__end")).alias("__end"), own.alias("__node"), F.when(own, F.col("__row")).alias("__row"))
    w = W.partitionBy(key, "level").orderBy("pos")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    n = F.count_if("__node").over(upto)
    # the first node below another stands right behind it
    parent = F.last(F.when(F.col("__node") & (F.col("__above") < F.col("level")), F.struct(F.col("__before").alias("pos"), F.col("__n").alias("n"))), ignorenulls=True).over(upto)
    leaf = F.coalesce(F.col("__below") <= F.col("level"), F.lit(True))
    last = F.when(leaf, F.col("pos")).otherwise(F.coalesce(F.col("__next"), F.col("__end")))
    out = events.withColumns({"__n": n, "__next": F.lead("__before").over(w)}).withColumn("__parent", parent).where("__node")
    idx = F.col("__n") - F.coalesce(F.col("__parent.n"), F.lit(1))
    return out.select(key, *[F.col(f"__row.{c}").alias(c) for c in names], "level", F.col("__parent.pos").alias("parent"), idx.alias("idx"), last.alias("last"))


def ancestors(rows: DataFrame, key: str, mark: Column | None = None) -> DataFrame:
    """(key, pos, above, ancestor, mark): each node of a tree table with each of its ancestors: their level, pos and ``mark``."""
    rows = rows.select(key, "pos", F.col("level").cast("int").alias("level"), (F.lit(None).cast("boolean") if mark is None else mark).alias("mark"))
    above = F.filter(F.sequence(F.lit(0), "level"), lambda k: k <= F.col("level"))
    events = rows.select(key, "pos", F.col("level").alias("__own"), "mark", F.explode(above).alias("above"))
    upto = W.partitionBy(key, "above").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    found = F.last(F.when(F.col("__own") == F.col("above"), F.struct("pos", "mark")), ignorenulls=True).over(upto)
    return events.withColumn("__a", found).where("above < __own").select(key, "pos", "above", F.col("__a.pos").alias("ancestor"), F.col("__a.mark").alias("mark"))


def spread_spans(rows: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """``rows`` with the span (start, end) of each node: its own, or for a node without one the union of those of the nearest nodes
    below that have one (null if none has). A tree table; other columns stay."""
    own = F.col(start).isNotNull() & F.col(end).isNotNull()
    up = ancestors(rows, key, own)
    nearest = F.coalesce(F.max(F.when(F.col("mark"), F.col("above"))).over(W.partitionBy(key, "pos")), F.lit(-1))
    up = up.withColumn("__nearest", nearest).where("above > __nearest")
    spans = up.join(rows.where(own).select(key, "pos", F.col(start).alias("__s"), F.col(end).alias("__e")), [key, "pos"])
    spans = spans.groupBy(key, F.col("ancestor").alias("pos")).agg(F.min("__s").alias("__s"), F.max("__e").alias("__e"))
    out = rows.join(spans, [key, "pos"], "left")
    return out.withColumns({start: F.when(own, F.col(start)).otherwise(F.col("__s")), end: F.when(own, F.col(end)).otherwise(F.col("__e"))}).select(rows.columns)


#: A piece of XML: character data, a comment, an instruction, a declaration, a tag (quoted values may hold >), or text.
PIECE = r"""(?s)(<!\[CDATA\[.*?\]\]>|<!--.*?-->|<\?.*?\?>|<!(?:[^<>\[]++|\[[^\]]*+\])*+>|<(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>|[^<]++)"""


def read_xml(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, level, name, attrs, text): the tree table of XML texts. Text nodes have a text and no name; namespaces are left off
    the names of elements. Character data is text; comments, instructions and declarations are left out, so is what stands
    outside of the root. A null text has no nodes; a text that isn't well formed gives what nests by its tags."""
    seen = rows.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(PIECE), 1)).alias("pos", "t"))
    t = F.col("t")
    tag = t.rlike(r"^<[^!?]")
    kind = F.when(t.startswith("</"), "close").when(tag & t.rlike("/>$"), "empty").when(tag, "open").when(t.startswith("<![CDATA["), "data").when(t.startswith("<"), None).otherwise("text")
    seen = seen.withColumn("kind", kind).where("kind IS NOT NULL")
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    level = F.coalesce(F.sum(step).over(W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    seen = seen.withColumn("level", level.cast("int")).where("kind <> 'close'")
    element = F.col("kind").isin("open", "empty")
    name = F.when(element, F.regexp_extract("t", r"^<(?:[^\s/>:]+:)?([^\s/>]+)", 1))
    pairs = F.regexp_extract_all("t", F.lit(r"""([\w:.-]+\s*=\s*(?:"[^"]*"|'[^']*'))"""), 1)
    attrs = F.map_from_entries(F.transform(F.array_distinct(pairs), lambda p: F.struct(F.regexp_extract(p, r"^([\w:.-]+)", 1).alias("key"), unescape_xml(F.regexp_extract(p, r"""(?s)["'](.*)["']$""", 1)).alias("value"))))
    said = F.when(F.col("kind") == "data", F.regexp_extract("t", r"(?s)^<!\[CDATA\[(.*)\]\]>$", 1)).when(F.col("kind") == "text", unescape_xml(t))
    made = seen.select(key, "pos", "level", name.alias("name"), F.when(element, attrs).otherwise(F.create_map().cast("map<string,string>")).alias("attrs"), said.alias("text"))
    return made.where("name IS NOT NULL OR level > 0")


#: What the JSON form calls elements that the XML form has other names for.
XML_NAME = {"table:row": "row", "table:cell": "cell"}


#: Nodes that are handed on at once.
BATCH = 10_000


def read_json(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, level, name, attrs, text, parent, idx, last): the tree table of JSON trees, in the names of the XML form (``style`` is the
    marker), with what ``nested_sets`` gives. A null or unreadable text has no nodes. Each row of a batch is taken apart for itself."""
    kind = dict(rows.dtypes)[key]

    def flat(document: str | None) -> list[list]:
        """A list for each column; a node's interval ends where the next node that isn't deeper begins."""
        try:
            root = json.loads(document or "null")
        except ValueError:
            root = None
        out: list[list] = [[] for _ in arrow]
        todo = [(0, None, 0, root)] if isinstance(root, dict) else []
        open_: list[int] = []
        while todo:
            level, parent, idx, node = todo.pop()
            pos = len(out[0])
            if isinstance(node, dict):
                attrs = [("style" if k == "marker" else k, str(v)) for k, v in node.items() if k not in ("type", "content") and isinstance(v, str | int | float)]
                made = XML_NAME.get(node.get("type"), node.get("type") or ""), attrs, None
                inner = node.get("content")
                inner = [x for x in (inner if isinstance(inner, list) else [inner] if inner else []) if isinstance(x, dict | str)]
                todo += [(level + 1, pos, i, inner[i]) for i in range(len(inner) - 1, -1, -1)]
            else:
                made = None, [], node
            while len(open_) > level:
                out[-1][open_.pop()] = pos - 1
            open_.append(pos)
            for column, value in zip(out, (pos, level, *made, parent, idx, pos), strict=True):
                column.append(value)
        for at in open_:
            out[-1][at] = len(out[0]) - 1
        return out

    arrow = [pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int32(), pa.int64(), pa.int32()]
    names = ["pos", "level", "name", "attrs", "text", "parent", "idx", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, columns = [], [[] for _ in arrow]
            for row, document in enumerate(b.column("text")):
                made = flat(document.as_py())
                at += [row] * len(made[0])
                for column, more in zip(columns, made, strict=True):
                    column += more
                if len(at) >= BATCH or (at and row == b.num_rows - 1):
                    # a long document goes on in pieces too
                    for lo in range(0, len(at), BATCH):
                        part = [pa.array(c[lo : lo + BATCH], k) for c, k in zip(columns, arrow, strict=True)]
                        yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(at[lo : lo + BATCH])), *part], [key, *names])
                    at, columns = [], [[] for _ in arrow]

    return rows.select(key, F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, pos int, level int, name string, attrs map<string,string>, text string, parent int, idx long, last int")


#: Attributes that have a place of their own in tagged text, or none. (Milestones keep sid and eid, figures alt.)
PLACED = ("style", "number", "sid", "eid", "vid", "closed", "caller", "category", "altnumber", "pubnumber", "align", "colspan", "code", "version", "alt")


def to_tagged(tree: DataFrame, key: str) -> DataFrame:
    """(key, text): books of a tree table (of ``read_xml`` or ``read_json``) as tagged text.

    Nested spans, notes with callers and categories, tables with joined columns, sidebars, figures, references, milestones,
    second numbers and all further attributes keep what they say; unknown elements give way to what they hold, and ends of
    chapters and verses (they have no number) are left out. Each node is a piece where it begins and one where its interval
    ends; pieces are put in order and joined.
    """
    rows = tree if "last" in tree.columns else nested_sets(tree, key)
    at = lambda name: F.element_at("attrs", F.lit(name))
    style, number = F.coalesce(at("style"), F.lit("")), at("number")
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    one = lambda name, value: F.when(has(value), F.concat(F.lit(f"\\{name} "), value, F.lit(f"\\{name}*"))).otherwise("")
    kept = (F.col("name") == "ms", ("sid", "eid")), (F.col("name").isin("char", "figure"), ("alt",))
    more = F.filter(F.map_entries("attrs"), lambda e: ~e["key"].isin(*PLACED) | (kept[0][0] & e["key"].isin(*kept[0][1])) | (kept[1][0] & e["key"].isin(*kept[1][1])))
    said = F.array_join(F.transform(more, lambda e: F.concat(e["key"], F.lit('="'), F.replace(e["value"], F.lit('"'), F.lit("'")), F.lit('"'))), " ")
    attributes = F.when(F.size(more) > 0, F.concat(F.lit("|"), said)).otherwise("")
    column = F.regexp_extract(style, r"(\d+)$", 1)
    cell = F.when(has(at("colspan")) & (column != ""), F.concat(style, F.lit("-"), (column.cast("int") + at("colspan").try_cast("int") - 1).cast("string")))
    slash = lambda c: F.concat(F.lit("\\"), c)
    name = F.col("name")
    numbered = has(number)
    begin = F.when(name == "book", F.concat(F.lit("\\id "), F.coalesce(at("code"), F.lit("")), F.lit(" ")))
    begin = begin.when((name == "chapter") & numbered, F.concat(F.lit("\\c "), number, F.lit("\n"), one("ca", at("altnumber")), F.when(has(at("altnumber")), "\n").otherwise(""), F.when(has(at("pubnumber")), F.concat(F.lit("\\cp "), at("pubnumber"), F.lit("\n"))).otherwise("")))
    begin = begin.when((name == "verse") & numbered, F.concat(F.lit("\\v "), number, F.lit(" "), one("va", at("altnumber")), F.when(has(at("altnumber")), " ").otherwise(""), one("vp", at("pubnumber")), F.when(has(at("pubnumber")), " ").otherwise("")))
    begin = begin.when(name.isin("para", "row") & (style != ""), F.concat(slash(style), F.lit(" ")))
    begin = begin.when((name == "cell") & (style != ""), F.concat(slash(F.coalesce(cell, style)), F.lit(" ")))
    begin = begin.when(name.isin("char", "figure") & (style != ""), F.concat(slash(style), F.lit(" "))).when(name == "ref", "\\ref ")
    begin = begin.when((name == "ms") & (style != ""), F.concat(slash(style), F.when(attributes != "", F.concat(F.lit(" "), attributes)).otherwise(""), F.lit("\\*")))
    begin = begin.when((name == "note") & (style != ""), F.concat(slash(style), F.lit(" "), F.coalesce(at("caller"), F.lit("+")), F.lit(" "), one("cat", at("category"))))
    begin = begin.when(name == "sidebar", F.concat(F.lit("\\esb "), one("cat", at("category")), F.lit("\n"))).when(name == "periph", F.concat(F.lit("\\periph "), F.coalesce(at("alt"), F.lit("")), attributes, F.lit("\n")))
    begin = begin.when(name == "optbreak", "//").when(name.isNull(), F.col("text"))
    end = F.when(name.isin("book", "para", "row"), "\n").when(name == "sidebar", "\\esbe\n").when(name == "ref", F.concat(attributes, F.lit("\\ref*")))
    end = end.when(name.isin("char", "figure") & (style != ""), F.concat(attributes, slash(style), F.lit("*"))).when((name == "note") & (style != ""), F.concat(slash(style), F.lit("*")))
    piece = lambda pos, phase, deep, t: F.struct(pos.alias("pos"), F.lit(phase).alias("phase"), deep.alias("deep"), t.alias("t"))
    pieces = F.filter(F.array(piece(F.col("pos"), 0, F.lit(0), begin), piece(F.col("last"), 1, -F.col("level"), end)), lambda x: x["t"].isNotNull())
    rows = rows.groupBy(key).agg(F.array_sort(F.flatten(F.collect_list(pieces))).alias("p"))
    return rows.select(key, F.array_join(F.transform("p", lambda x: x["t"]), "").alias("text"))
