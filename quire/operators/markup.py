"""Tagged text to a node table, by lexing inside the JVM and windows over document order.

A book's text is cut at its markers into tokens. A token's kind comes from the marker dimension, or from its form and
place where it is unknown. Chapter, verse, paragraph and nesting are running values, so no parser walks the text.
"""

from __future__ import annotations

import json
import re
from collections import namedtuple
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quire.functions.markers import base_marker, cell_span, dim_marker, well_formed
from quire.functions.text import collapse, escape_xml, join_fragments, let
from quire.operators.windows import depth

#: Tells rows of a key apart that hold different texts.
DOC = "doc_hash"


def tokens(books: DataFrame, key: str, text: str) -> DataFrame:
    """(key, doc_hash, pos, nested, marker, closing, raw): one row for each marker with the text up to the next one.

    Rows that share a key, null included, are documents of their own, told apart by ``doc_hash`` in all that follows; rows
    equal in key and text are one (``typed`` leaves the repeats out).
    """
    found = F.regexp_extract_all(F.col(text), F.lit(r"(\\[^\\]*)"), 1)
    rows = books.select(key, F.xxhash64(F.lit("document"), text).alias(DOC), F.posexplode(found).alias("pos", "token"))
    # marker names hold neither backslashes nor stars nor white space: the name ends at the first of these
    name = F.regexp_extract("token", r"^\\\+?([^\s\\*]*)", 1)
    nested = F.substr("token", F.lit(2), F.lit(1)) == "+"
    after = F.length(name) + F.when(nested, 3).otherwise(2)
    rows = rows.select(key, DOC, "pos", "token", nested.alias("nested"), name.alias("marker"), after.alias("__after"))
    closing = F.substr("token", "__after", F.lit(1)) == "*"
    raw = F.substr("token", F.col("__after") + closing.cast("int"), F.length("token"))
    return rows.select(key, DOC, "pos", "nested", "marker", closing.alias("closing"), raw.alias("raw"))


def by(rows: DataFrame, key: str) -> list[str]:
    """The columns that tell documents apart: the key, and ``doc_hash`` where rows come from ``tokens``."""
    return [key, DOC] if DOC in rows.columns else [key]


def typed(rows: DataFrame, key: str, extra: list[tuple[str, str, str]] = ()) -> DataFrame:
    """Adds kind, style, default_attribute. A marker not listed is taken as its listed base; else it is a milestone if its name
    says so or it closes itself, a paragraph if it opens a line, and a character span otherwise. Each document is judged alone."""
    markers = dim_marker(rows.sparkSession, list(extra))  # a few hundred rows
    exact = F.broadcast(markers)
    bases = F.broadcast(markers.select(F.col("marker").alias("__base"), F.col("kind").alias("__kind"), F.col("style").alias("__style"), F.col("default_attribute").alias("__attr")))
    w = W.partitionBy(*by(rows, key)).orderBy("pos")
    rows = rows.withColumn("__again", F.lag("pos").over(w).eqNullSafe(F.col("pos"))).where("NOT __again").drop("__again")
    out = rows.withColumns({"__first": F.coalesce(F.lag("raw").over(w).rlike(r"\n\s*$"), F.lit(True)), "__ends": F.coalesce((F.lead("marker").over(w) == "") & F.lead("closing").over(w), F.lit(False))})
    out = out.join(exact, "marker", "left").join(bases, base_marker(F.col("marker")) == F.col("__base"), "left")
    cell = cell_span(F.col("marker")).isNotNull()  # cells of any column
    guess = F.when(F.col("marker") == "", "end").when(cell, "character").when(F.col("marker").rlike("-[se]$") | F.col("__ends"), "milestone").when(F.col("__first") & ~F.col("closing"), "paragraph").otherwise("character")
    style = F.when(F.col("marker") == "", "end").when(cell, "cell").otherwise("unknown")
    out = out.withColumns({"kind": F.coalesce("kind", "__kind", guess), "style": F.coalesce("style", "__style", style), "default_attribute": F.coalesce("default_attribute", "__attr")}).drop("__first", "__ends", "__base", "__kind", "__style", "__attr")
    return _note_closers(out, key)


#: Parts of notes whose end may be written as the note's own closer, with more of the note to follow.
CLOSED_BY_NOTE = ("fqa", "fdc")


def _note_closers(rows: DataFrame, key: str) -> DataFrame:
    """A note's closer ends the part that is open, and with it the note. After ``CLOSED_BY_NOTE`` the note goes on if the line has
    another closer of it and no opener before that: such a closer becomes the part's own.

    The open part is a running value, what follows on the line the next note marker of that name and a running count of line ends.
    """
    opens, note = ~F.col("closing"), F.col("kind") == "note"
    w = W.partitionBy(*by(rows, key)).orderBy("pos")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    part = F.when(F.col("style") == "note part", F.when(opens, F.col("marker")).otherwise("")).when(note, "")
    line = F.coalesce(F.sum(F.regexp_count("raw", F.lit(r"\n"))).over(before), F.lit(0))
    rows = rows.withColumns({"__part": F.last(part, ignorenulls=True).over(before), "__line": line})
    same = W.partitionBy(*by(rows, key), "__name").orderBy("pos")
    rows = rows.withColumn("__name", F.when(note, F.col("marker")))  # among other rows the lead means nothing
    goes_on = F.lead("closing").over(same) & (F.lead("__line").over(same) == F.col("__line"))
    inner = note & ~opens & F.col("__part").isin(*CLOSED_BY_NOTE) & F.coalesce(goes_on, F.lit(False))
    rows = rows.withColumn("__inner", inner)
    changed = {"marker": F.when(F.col("__inner"), F.col("__part")).otherwise(F.col("marker")), "kind": F.when(F.col("__inner"), "character").otherwise(F.col("kind")), "style": F.when(F.col("__inner"), "note part").otherwise(F.col("style"))}
    return rows.withColumns(changed).drop("__part", "__line", "__name", "__inner")


def attributes(raw: Column, default: Column) -> Column:
    """The map after the first bar: key="value" pairs, or a bare value under the default attribute. Empty values are left out; a
    name that comes again keeps its place and takes its last value."""
    part = F.regexp_extract(raw, r"(?s)^[^|]*\|(.*)$", 1)
    pairs = F.regexp_extract_all(part, F.lit(r'([\w-]+\s*=\s*"[^"]*")'), 1)
    entries = F.filter(F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"^([\w-]+)", 1).alias("name"), F.regexp_replace(F.regexp_extract(p, r'(?s)"(.*)"$', 1), r"\s+", " ").alias("value"))), lambda e: e["value"] != "")
    backwards = let(F.reverse(entries), lambda r: F.struct(F.array_distinct(F.reverse(r["name"])).alias("each"), r["name"].alias("names"), r["value"].alias("values")))
    named = let(backwards, lambda b: F.map_from_arrays(b["each"], F.transform(b["each"], lambda n: F.element_at(b["values"], F.array_position(b["names"], n).cast("int")))))
    bare = F.trim(part)
    return F.when(part.contains("="), named).when((bare != "") & default.isNotNull(), F.create_map(default, bare)).otherwise(F.create_map().cast("map<string,string>"))


def nodes(books: DataFrame, key: str, text: str, extra: list[tuple[str, str, str]] = ()) -> DataFrame:
    """(key, doc_hash, pos, kind, style, marker, nested, closing, book, chapter, verse, sid, para, depth, in_note, number, text, attrs).

    text is the token's own text without numbers and attributes, white space folded; book, chapter and verse are those
    in force (a new chapter has no verse yet); para counts paragraphs; depth counts open character spans. A null text has
    no nodes. Numbers are text, as in ``12a``.
    """
    rows = typed(tokens(books, key, text), key, extra)
    opens = ~F.col("closing")
    is_ = lambda m: (F.col("marker") == m) & opens
    number = F.when(F.col("style").isin("chapter", "verse") & opens, F.regexp_extract("raw", r"^\s*(\S+)", 1))
    body = F.when(number.isNotNull(), F.regexp_replace("raw", r"^\s*\S+\s?", ""))
    body = body.when(F.col("kind").isin("character", "milestone") & opens & F.col("raw").contains("|"), F.regexp_extract("raw", r"(?s)^\s?([^|]*)", 1))
    body = body.when(F.col("kind").isin("note") & opens, F.regexp_replace("raw", r"^\s?\S(\s|$)", "")).when(opens, F.regexp_replace("raw", r"^\s", "")).otherwise(F.col("raw"))
    # what has a number keeps the bars of its text
    has_attrs = F.col("kind").isin("character", "milestone") & opens & number.isNull()
    rows = rows.withColumns({"number": number, "text": F.regexp_replace(body, r"\s+", " "), "attrs": F.when(has_attrs, attributes(F.col("raw"), F.col("default_attribute"))).when((F.col("kind") == "note") & opens, F.create_map(F.lit("caller"), F.regexp_extract("raw", r"^\s*(\S?)", 1))).otherwise(F.create_map().cast("map<string,string>"))})
    doc = by(rows, key)
    w = W.partitionBy(*doc).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("book", F.last(F.when(is_("id"), F.upper(F.regexp_extract("raw", r"^\s*(\S+)", 1))), ignorenulls=True).over(w))
    rows = rows.withColumn("chapter", F.last(F.when(is_("c"), F.col("number")), ignorenulls=True).over(w))
    # all by the document's own order, so that rows are sorted once: a chapter begins without a verse
    verse = F.last(F.when(is_("c") | is_("v") & F.col("number").isNotNull(), F.struct(F.when(is_("v"), F.col("number")).alias("v"))), ignorenulls=True).over(w)
    rows = rows.withColumn("verse", verse["v"])
    sid = F.when(F.col("book").isNotNull() & F.col("verse").isNotNull(), F.concat("book", F.lit(" "), "chapter", F.lit(":"), "verse"))
    rows = rows.withColumns({"sid": sid, "para": F.count(F.when((F.col("kind") == "paragraph") & opens, 1)).over(w)})
    span = (F.col("kind") == "character") & ~F.col("style").isin("verse", "cell", "note part")
    step = F.when(span & opens, 1).when(span, -1).otherwise(0)
    rows = depth(rows, doc, ["pos"], step, part="para")
    note = F.when((F.col("kind") == "note") & opens, 1).when(F.col("kind") == "note", -1).otherwise(0)
    rows = depth(rows, doc, ["pos"], note, "__note", part="para")
    names = "pos kind style marker nested closing book chapter verse sid para depth".split()
    return rows.select(*doc, *names, (F.col("__note") > 0).alias("in_note"), "number", "text", "attrs")


def fragment_nodes(rows: DataFrame, key: str, text: str, book: str, chapter: str) -> DataFrame:
    """As ``nodes``, of pieces of a chapter without a book line, whose book and chapter are in columns."""
    head = F.concat(F.lit("\\id "), F.col(book), F.lit("\n\\c "), F.col(chapter).cast("string"), F.lit("\n"))
    whole = nodes(rows.select(key, F.concat(head, F.col(text)).alias(text)), key, text)
    return whole.where("pos > 1").withColumn("pos", F.col("pos") - 2)


def verse_texts(node: DataFrame, key: str, notes: bool = False) -> DataFrame:
    """(key, book, chapter, verse, sid, text): running text of each verse, with spaces where fragments would be glued; notes
    and figures only if asked for."""
    rows = node.where("verse IS NOT NULL")
    if not notes:
        rows = rows.where("NOT in_note AND style <> 'figure'")
    # alternative and published numbers aren't text
    rows = rows.where("NOT (style = 'number' AND NOT closing)")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    whole = collapse(join_fragments(parts))
    return rows.groupBy(*by(rows, key), "book", "chapter", "verse", "sid").agg(whole.alias("text")).drop(DOC)


def word_attributes(node: DataFrame, key: str) -> DataFrame:
    """(key, sid, pos, surface, attribute, value) of the words marked with attributes."""
    rows = node.where("marker = 'w' AND NOT closing")
    return rows.select(key, "sid", "pos", collapse(F.col("text")).alias("surface"), F.explode("attrs").alias("attribute", "value"))


def chapters(node: DataFrame, key: str) -> DataFrame:
    """(key, book, chapter, n_nodes, n_verses): a slice of the book; chapter 0 stands for what is before the first."""
    chapter = F.coalesce(F.col("chapter"), F.lit("0")).alias("chapter")
    verses = F.count_if((F.col("marker") == "v") & ~F.col("closing"))
    return node.groupBy(*by(node, key), chapter).agg(F.coalesce(F.max("book"), F.lit("UNK")).alias("book"), F.count("*").alias("n_nodes"), verses.alias("n_verses")).drop(DOC)


def render_usfm(rows: DataFrame, key: str) -> DataFrame:
    """(key, text): tokens back as tagged text, marker by marker."""
    one = F.concat(F.lit("\\"), F.when(F.col("nested"), "+").otherwise(""), "marker", F.when(F.col("closing"), "*").otherwise(""), "raw")
    return rows.groupBy(*by(rows, key)).agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(F.col("pos"), one.alias("t")))), lambda x: x["t"]), "").alias("text")).drop(DOC)


def _attribute_text(attrs: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(attrs)), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), escape_xml(e["value"]), F.lit('"'))), "")


def render_xml(node: DataFrame, key: str, html: bool = False) -> DataFrame:
    """(key, text): the nodes as XML (para, char, note, chapter, verse with sid and eid, ms), or as plain HTML."""
    w = W.partitionBy(*by(node, key)).orderBy("pos")
    open_para = F.last(F.when((F.col("kind") == "paragraph") & ~F.col("closing"), F.col("style") != "chapter"), ignorenulls=True)
    before, upto = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(W.unboundedPreceding, 0)
    last = F.lead("pos").over(w).isNull()
    rows = node.withColumns({"__open": F.coalesce(open_para.over(before), F.lit(False)), "__left": F.coalesce(open_para.over(upto), F.lit(False)), "__sid": F.last("sid", ignorenulls=True).over(before), "__last": last})
    # the verse that is open before a row: none once a chapter has begun, until its first verse
    rows = rows.withColumn("__sid", F.when(F.lag("sid").over(w).isNotNull(), F.col("__sid")))
    inner = escape_xml(F.col("text"))
    style = F.concat(F.lit(' style="'), "marker", F.lit('"'))
    opens = ~F.col("closing")
    # parts of notes and table cells have no closers of their own: each holds its own text
    part = F.col("style").isin("note part", "cell")
    paragraph = (F.col("kind") == "paragraph") & opens & ~F.col("style").isin("chapter")
    tag = lambda name, *more: F.concat(F.lit(f"<{name}"), *more, F.lit(">"))
    if html:
        start = F.when(paragraph, F.concat(tag("p", F.concat(F.lit(' class="'), "marker", F.lit('"'))), inner))
        start = start.when((F.col("kind") == "note") & opens, F.concat(F.lit("<sup>"), inner)).when(F.col("kind") == "note", F.concat(F.lit("</sup>"), inner))
        start = start.when(F.col("style").isin("chapter", "verse") & opens, F.concat(tag("span", F.concat(F.lit(' class="'), "marker", F.lit('"'))), "number", F.lit("</span>"), inner))
        start = start.when(part & opens, F.concat(tag("span", F.concat(F.lit(' class="'), "marker", F.lit('"'))), inner, F.lit("</span>"))).when(part, inner)
        start = start.when((F.col("kind") == "character") & opens, F.concat(tag("span", F.concat(F.lit(' class="'), "marker", F.lit('"'))), inner)).when(F.col("kind") == "character", F.concat(F.lit("</span>"), inner)).otherwise(inner)
        closes = F.when((F.col("kind") == "paragraph") & opens & F.col("__open"), "</p>").otherwise("")
        ends = F.when(F.col("__last") & F.col("__left"), "</p>").otherwise("")
    else:
        end_of = lambda sid: F.when(sid.isNotNull(), F.concat(F.lit('<verse eid="'), sid, F.lit('"/>'))).otherwise("")
        eid = F.when(F.col("style").isin("verse", "chapter") & opens, end_of(F.col("__sid"))).otherwise("")
        milestone = F.concat(F.lit("<ms"), style, _attribute_text(F.col("attrs")), F.lit("/>"))
        numbered = lambda name: F.concat(F.lit(f'<{name} number="'), "number", F.lit('"'), style, F.when(F.col("sid").isNotNull() & F.lit(name == "verse"), F.concat(F.lit(' sid="'), "sid", F.lit('"'))).otherwise(""), F.lit("/>"))
        start = F.when(paragraph, F.concat(tag("para", style), inner)).when((F.col("style") == "chapter") & opens, numbered("chapter")).when((F.col("style") == "verse") & opens, F.concat(numbered("verse"), inner))
        start = start.when((F.col("kind") == "note") & opens, F.concat(tag("note", style, _attribute_text(F.col("attrs"))), inner)).when(F.col("kind") == "note", F.concat(F.lit("</note>"), inner))
        start = start.when(part & opens, F.concat(F.when(F.col("style") == "cell", tag("cell", style)).otherwise(tag("char", style)), inner, F.when(F.col("style") == "cell", "</cell>").otherwise("</char>"))).when(part, inner)
        start = start.when((F.col("kind") == "milestone") & opens, F.concat(milestone, inner)).when((F.col("kind") == "character") & opens, F.concat(tag("char", style, _attribute_text(F.col("attrs"))), inner)).when(F.col("kind") == "character", F.concat(F.lit("</char>"), inner)).otherwise(inner)
        closes = F.concat(eid, F.when((F.col("kind") == "paragraph") & opens & F.col("__open"), "</para>").otherwise(""))
        ends = F.when(F.col("__last"), F.concat(end_of(F.col("sid")), F.when(F.col("__left"), "</para>").otherwise(""))).otherwise("")
    pieces = F.array_sort(F.collect_list(F.struct(F.col("pos"), F.concat(closes, start, ends).alias("t"))))
    return rows.groupBy(*by(rows, key)).agg(F.array_join(F.transform(pieces, lambda x: x["t"]), "").alias("text")).drop(DOC)


def encode_documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text): plain documents as tagged books, a verse for each line that isn't blank."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    verses = F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit("\\v "), (i + 1).cast("string"), F.lit(" "), x)), "\n")
    head = F.concat(F.lit("\\id D"), F.col(key).cast("string"), F.lit("\n\\c 1\n\\p\n"))
    return docs.select(key, F.concat(head, verses).alias("text"))


def encode_words(docs: DataFrame, key: str, words: DataFrame) -> DataFrame:
    """(key, text): each word of (key, idx, surface, occurrence, occurrences) as a marked word in one verse."""
    one = F.concat(F.lit("\\w "), "surface", F.lit('|x-occurrence="'), F.col("occurrence").cast("string"), F.lit('" x-occurrences="'), F.col("occurrences").cast("string"), F.lit('"\\w*'))
    rows = words.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("idx"), one.alias("t")))), lambda x: x["t"]), " ").alias("__w"))
    head = F.concat(F.lit("\\id W"), F.col(key).cast("string"), F.lit("\n\\c 1\n\\p\n\\v 1 "))
    return docs.select(key).join(rows, key).select(key, F.concat(head, "__w").alias("text"))


def format_usfm(rows: DataFrame, key: str, verse_on_new_line: bool = True, content_on_new_line: bool = False) -> DataFrame:
    """(key, text): typed tokens as tagged text in a house style.

    Paragraph markers start a line, verses start one or follow a space, spans and notes follow directly; one space (or for
    paragraphs with ``content_on_new_line`` a line end) stands between a marker and its content, and runs of white space
    in content are one space. The book line stays on one line.
    """
    opens = ~F.col("closing") & (F.col("marker") != "")
    line = F.when(F.col("style") == "book", "").when(opens & (F.col("kind") == "paragraph"), "\n").when(opens & (F.col("style") == "verse"), "\n" if verse_on_new_line else " ").otherwise("")
    body = F.regexp_replace("raw", r"\s+", " ")
    trimmed = F.regexp_replace(body, "^ ", "")
    lead = F.when(~opens, "").when((F.col("kind") == "paragraph") & (trimmed != "") & F.lit(content_on_new_line) & ~F.col("style").isin("book", "chapter", "heading"), "\n").when(trimmed != "", " ").otherwise("")
    w = W.partitionBy(*by(rows, key)).orderBy("pos")
    # a line end takes the place of a space before it
    next_line = F.coalesce(F.lead(line).over(w), F.lit("\n")) != ""
    content = F.when(opens, trimmed).otherwise(body)
    content = F.when(next_line, F.regexp_replace(content, r"\s+$", "")).otherwise(content)
    lead = F.when(content == "", "").otherwise(lead)
    piece = F.concat(line, F.lit("\\"), F.when(F.col("nested"), "+").otherwise(""), "marker", F.when(F.col("closing"), "*").otherwise(""), lead, content)
    made = rows.withColumn("__t", piece)
    return made.groupBy(*by(made, key)).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("pos"), F.col("__t").alias("t")))), lambda x: x["t"]), "").alias("text")).drop(DOC)


#: How each kind of node is called in the JSON form.
USJ_TYPE = {"book": "book", "chapter": "chapter", "verse": "verse", "row": "table:row", "cell": "table:cell", "sidebar": "sidebar", "ref": "ref"}


#: Markers that are attributes of the chapter or verse before them.
ABSORBED = {"ca": "altnumber", "va": "altnumber", "cp": "pubnumber", "vp": "pubnumber"}


def to_usj(node: DataFrame, key: str) -> DataFrame:
    """(key, usj): each book's nodes nested as JSON: rows in tables, sidebars around their paragraphs, // as optional breaks,
    alternative and published numbers and categories as attributes. A book is folded by itself, with a stack of what is open.

    Rows come in the order of a window over books, in which a book's first row has number 1, and in batches that hold many books.
    """

    def trim(content: list) -> None:
        """No white space at the end of a paragraph."""
        if content and isinstance(content[-1], str):
            content[-1] = content[-1].rstrip()

    def fold(rows: Iterator[tuple]) -> str:
        root: list = []
        outer = para = root
        stack: list = []
        counted, holder = {}, {}  # the last chapter or verse; the sidebar or note whose category comes next
        for r in rows:
            here = stack[-1][1] if stack else para
            if r.marker == "usfm":
                continue
            if r.kind == "paragraph" and not r.closing and r.marker not in ABSORBED:
                trim(para)
            if r.closing:
                names = [m for m, _, _ in stack]
                if r.marker in names:  # a closer also ends what is open inside
                    del stack[len(names) - 1 - names[::-1].index(r.marker) :]
                here = stack[-1][1] if stack else para
            elif r.marker in ABSORBED and counted:
                counted[ABSORBED[r.marker]] = r.text.strip()
                continue
            elif r.marker == "cat" and holder:
                holder["category"] = r.text.strip()
                continue
            elif r.kind == "paragraph" or r.style == "verse":
                item = {"type": USJ_TYPE.get(r.style, "para"), "marker": r.marker}
                if r.number is not None:
                    item["number"] = r.number
                if r.style == "chapter" and r.book is not None:
                    item["sid"] = f"{r.book} {r.number}"
                if r.style == "book":
                    item["code"], _, said = r.text.strip().partition(" ")
                    said = said.strip()
                counted = item if r.style in ("chapter", "verse") else {} if r.kind == "paragraph" and r.marker != "cp" else counted
                holder = item if r.style == "sidebar" else {} if r.style == "chapter" else holder
                if r.style == "verse":
                    if r.sid is not None:
                        item["sid"] = r.sid
                    here.append(item)
                elif r.marker == "esbe":
                    stack, outer = [], root
                    para = here = root
                else:
                    stack = []
                    if r.style == "chapter":
                        outer = root
                    if r.style == "row":
                        table = outer[-1] if outer and isinstance(outer[-1], dict) and outer[-1]["type"] == "table" else None
                        if table is None:
                            table = {"type": "table", "content": []}
                            outer.append(table)
                        table["content"].append(item)
                    else:
                        (root if r.style == "sidebar" else outer).append(item)
                    para = here = outer if r.style == "chapter" else item.setdefault("content", [])
                    if r.style == "sidebar":
                        outer = para
            elif r.marker:
                kind = "ms" if r.kind == "milestone" else "note" if r.kind == "note" else USJ_TYPE.get(r.style, "char")
                item = {"type": kind, **({} if kind == "ref" else {"marker": r.marker}), **dict(r.attrs or {})}
                holder = item if kind == "note" else holder
                if r.style == "cell":
                    item["align"] = {"r": "end", "c": "center"}.get(r.marker[2:3], "start")
                    first, _, to = r.marker.partition("-")
                    if to:
                        item |= {"marker": first, "colspan": str(int(to) - int(first.lstrip("thcr")) + 1)}
                if r.style in ("note part", "cell"):
                    stack = stack[: next((k for k, x in enumerate(stack) if x[2]), len(stack))] if r.style == "note part" else []
                    here = stack[-1][1] if stack else para
                here.append(item)
                if kind != "ms":
                    here = item["content"] = []
                    stack.append((r.marker, here, r.style in ("note part", "cell")))
            said = r.text if r.style != "book" or r.closing else said
            if said and said.strip():
                for k, piece in enumerate(said.split("//")):
                    here += [{"type": "optbreak"}] if k else []
                    here += [piece] if piece.strip() else []
        trim(para)
        return json.dumps({"type": "USJ", "version": "3.1", "content": root}, ensure_ascii=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []

        def numbered_rows() -> Iterator[tuple]:
            """(number of the book, row)"""
            for b in batches:
                first = b.column("__n").to_numpy() == 1
                names = b.column(key)
                values = [_maps(b.column(c)) if c == "attrs" else b.column(c).to_numpy(zero_copy_only=False).tolist() for c in columns]
                for i, (begins, r) in enumerate(zip(first.tolist(), map(Row._make, zip(*values, strict=True)), strict=True)):
                    if begins:
                        keys.append(names[i].as_py())
                    yield len(keys), r

        made, size, done = [], 0, 0
        for n, rows in groupby(numbered_rows(), itemgetter(0)):
            made.append(fold(r for _, r in rows))
            size += len(made[-1])
            if size > BATCH_CHARS:
                yield pa.RecordBatch.from_arrays([pa.array(keys[done:n], of_key), pa.array(made, pa.string())], [key, "usj"])
                made, size, done = [], 0, n
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(keys[done:], of_key), pa.array(made, pa.string())], [key, "usj"])

    kind, of_key = dict(node.dtypes)[key], to_arrow_type(node.schema[key].dataType)
    columns = ["kind", "style", "marker", "closing", "book", "sid", "number", "text", "attrs"]
    Row = namedtuple("Row", columns)
    place = F.row_number().over(W.partitionBy(*by(node, key)).orderBy("pos"))
    return node.withColumn("__n", place).select(key, "__n", *columns).mapInArrow(run, f"{key} {kind}, usj string")


#: Characters of JSON text that are handed on at once.
BATCH_CHARS = 8_000_000


def _maps(column: pa.MapArray) -> list[list[tuple]]:
    """The entries of each map."""
    at = column.offsets.to_numpy().tolist()
    entries = list(zip(column.keys.to_numpy(zero_copy_only=False).tolist(), column.items.to_numpy(zero_copy_only=False).tolist(), strict=True))
    return [entries[lo:hi] for lo, hi in zip(at, at[1:], strict=False)]


#: XML elements of the nodes whose type has another name.
USX_TAG = {"table:row": "row", "table:cell": "cell"}
#: Paragraphs that hold no verse text.
HEADING = re.compile(r"^(s|ms|mr|r|d|sp|sr|qa|rem|cl|cd|mt|mte|imt|h|toc|toca)\d*$")


def to_usx(trees: DataFrame, key: str) -> DataFrame:
    """(key, usx): JSON trees (key, usj) of ``to_usj`` as XML books. A verse's end stands behind its last text, before the next
    verse or at the end of a paragraph, a chapter's before the next chapter or at the end of the book."""
    kind = dict(trees.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "usx": [None if t is None else _usx(json.loads(t)) for t in pdf["usj"]]})

    return trees.select(key, "usj").mapInPandas(run, f"{key} {kind}, usx string")


def _usx(tree: dict) -> str:
    out: list[str] = []
    open_ = {"verse": None, "chapter": None, "spot": 0}

    def end(level: str) -> None:
        if open_[level] is not None:
            at = open_["spot"] if level == "verse" else len(out)
            out.insert(at, f'<{level} eid="{escape(open_[level])}"/>')
            open_[level] = None

    def walk(node, text: bool) -> None:
        if isinstance(node, str):
            out.append(escape(node))
        else:
            kind, marker = node["type"], node.get("marker")
            if kind in ("chapter", "verse"):
                end("verse")
                if kind == "chapter":
                    end("chapter")
            named = {**({"style": marker} if marker else {}), **{k: v for k, v in node.items() if k not in ("type", "marker", "content")}}
            head = "<" + USX_TAG.get(kind, kind) + "".join(f" {k}={quoteattr(str(v))}" for k, v in named.items())
            if kind in ("chapter", "verse"):
                open_[kind] = node.get("sid")
            inner = node.get("content") or []
            out.append(head + (">" if inner else "/>"))
            said = text or kind == "para" and not HEADING.match(marker or "")
            for x in inner:
                walk(x, said and kind in ("para", "table", "table:row", "table:cell"))
            out.extend([f"</{USX_TAG.get(kind, kind)}>"] if inner else [])
        if text:
            open_["spot"] = len(out)

    for node in tree["content"]:
        walk(node, False)
    end("verse")
    end("chapter")
    return f'<?xml version="1.0" encoding="utf-8"?>\n<usx version="{tree["version"]}">' + "".join(out) + "</usx>"


PREAMBLE = (("identification", r"^(id|ide|h\d?|toc\d?|toca\d?|rem|sts|usfm)$"), ("title", r"^(mt|mte|imt|imte)\d?$"), ("introduction", r"^i"))


def preamble_part(marker: Column) -> Column:
    """Which part of a book's preamble a marker belongs to."""
    out = F.lit("other")
    for name, pattern in reversed(PREAMBLE):
        out = F.when(marker.rlike(pattern), name).otherwise(out)
    return out


def numbers(node: DataFrame, key: str) -> DataFrame:
    """(key, pos, marker, number, sid, alternative, published): each chapter and verse with the numbers that ca and cp, or va and
    vp, give it until the next one."""
    opens = ~F.col("closing")
    own = F.col("style").isin("chapter", "verse") & opens
    rows = node.withColumn("__owner", F.last(F.when(own, F.col("pos")), ignorenulls=True).over(W.partitionBy(*by(node, key)).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))
    said = lambda *names: F.first(F.when(F.col("marker").isin(*names) & opens, F.trim("text")), ignorenulls=True)
    of = lambda c: F.max(F.when(own, F.col(c))).alias(c)
    return rows.where("__owner IS NOT NULL").groupBy(*by(node, key), F.col("__owner").alias("pos")).agg(of("marker"), of("number"), of("sid"), said("ca", "va").alias("alternative"), said("cp", "vp").alias("published")).drop(DOC)


def inferred_markers(rows: DataFrame, key: str) -> DataFrame:
    """(key, marker, kind, n): markers of typed tokens that aren't listed, with the kind they were taken for."""
    return rows.where("style = 'unknown' AND NOT closing").groupBy(key, "marker", "kind").agg(F.count("*").alias("n"))


def parse_log(rows: DataFrame, key: str) -> DataFrame:
    """(key, pos, level, message): what is odd about typed tokens: badly formed and unlisted markers, chapters and verses without a
    number, closers without an opener in their paragraph, notes that their paragraph leaves open."""
    opens = ~F.col("closing")
    w = W.partitionBy(*by(rows, key)).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("__para", F.count_if((F.col("kind") == "paragraph") & opens).over(w))
    same = W.partitionBy(*by(rows, key), "__para", "marker")
    step = F.when(F.col("kind").isin("character", "note"), F.when(opens, 1).otherwise(-1)).otherwise(0)
    rows = rows.withColumn("__open", F.sum(step).over(same.orderBy("pos").rowsBetween(W.unboundedPreceding, 0))).withColumn("__last", F.lead("pos").over(same.orderBy("pos")).isNull())
    name = F.concat(F.lit("\\"), "marker")
    found = F.array(
        F.when((F.col("marker") != "") & ~well_formed(F.col("marker")), F.struct(F.lit("error"), F.concat(name, F.lit(": badly formed marker")))),
        F.when((F.col("style") == "unknown") & opens, F.struct(F.lit("warn"), F.concat(name, F.lit(": unlisted marker taken as "), "kind"))),
        F.when(F.col("style").isin("chapter", "verse") & opens & ~F.col("raw").rlike(r"^\s*\d"), F.struct(F.lit("error"), F.concat(name, F.lit(": no number")))),
        F.when(F.col("closing") & (F.col("marker") != "") & F.col("kind").isin("character", "note") & (F.col("__open") < 0), F.struct(F.lit("warn"), F.concat(name, F.lit("*: nothing to close")))),
        F.when((F.col("marker") == "usfm") & opens & ~F.col("raw").rlike(r"^\s*3\.1\s*$"), F.struct(F.lit("warn"), F.concat(name, F.lit(": version isn't 3.1")))),
        F.when((F.col("kind") == "note") & F.col("__last") & (F.col("__open") > 0), F.struct(F.lit("warn"), F.concat(name, F.lit(": note isn't closed")))),
    )
    made = rows.select(key, "pos", F.explode(F.array_compact(found)).alias("f"))
    return made.select(key, "pos", F.col("f.col1").alias("level"), F.col("f.col2").alias("message"))


def sidebars(node: DataFrame, key: str) -> DataFrame:
    """(key, sidebar, first, last, category): sidebars from esb to esbe, or to the next one or the end of the book."""
    opens = ~F.col("closing")
    w = W.partitionBy(*by(node, key)).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    begins, ends = (F.col("marker") == "esb") & opens, (F.col("marker") == "esbe") & opens
    rows = node.withColumn("sidebar", F.count_if(begins).over(w)).where("sidebar > 0")
    inside = W.partitionBy(*by(node, key), "sidebar").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("__past", F.coalesce(F.count_if(ends).over(inside), F.lit(0))).where("__past = 0")
    category = F.first(F.when((F.col("marker") == "cat") & opens, F.trim("text")), ignorenulls=True)
    return rows.groupBy(*by(node, key), "sidebar").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), category.alias("category")).drop(DOC)


def matching_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Typed tokens with the rule (name, priority, before, after) that fits them best: rules are (name, marker, kind, style,
    priority, before, after) in which null fits all; the highest priority wins, then the first name.

    Rules meet the distinct kinds of tokens, of which there are as many as markers; these join the tokens.
    """
    kinds = rows.select("marker", "kind", "style").distinct()
    r = rules.select("name", "priority", "before", "after", *[F.col(c).alias(f"__{c}") for c in ("marker", "kind", "style")])
    fits = [F.col(f"__{c}").isNull() | (F.col(f"__{c}") == F.col(c)) for c in ("marker", "kind", "style")]
    best = F.min_by(F.struct("name", "priority", "before", "after"), F.struct(-F.col("priority"), "name"))
    chosen = kinds.join(r, fits[0] & fits[1] & fits[2]).groupBy("marker", "kind", "style").agg(best.alias("rule"))
    return rows.join(chosen, ["marker", "kind", "style"], "left")


def breaches(rows: DataFrame, key: str) -> DataFrame:
    """(key, pos, rule): tokens of ``matching_rules`` whose white space isn't the rule's: ``before`` is what the text before the
    marker has to end with, ``after`` what follows the marker; null asks for nothing."""
    w = W.partitionBy(*by(rows, key)).orderBy("pos")
    behind = F.regexp_extract(F.lag("raw").over(w), r"(\s*)$", 1)
    ahead = F.regexp_extract("raw", r"^(\s*)", 1)
    bad = (F.col("rule.before").isNotNull() & behind.isNotNull() & (behind != F.col("rule.before"))) | (F.col("rule.after").isNotNull() & (ahead != F.col("rule.after")))
    return rows.withColumn("__bad", F.coalesce(bad, F.lit(False))).where("__bad AND NOT closing AND marker <> ''").select(key, "pos", F.col("rule.name").alias("rule"))


def chapter_context(selected: DataFrame, key: str, chapter: str, last: str, radius: int) -> DataFrame:
    """(key, chapter, readonly): selected chapters with ``radius`` more on either side, within 1 and the last."""
    around = F.sequence(F.greatest(F.col(chapter) - radius, F.lit(1)), F.least(F.col(chapter) + radius, F.col(last)))
    wide = selected.where(F.col(chapter).between(1, F.col(last))).select(key, F.explode(around).alias(chapter)).distinct()
    own = selected.select(key, chapter, F.lit(False).alias("readonly")).distinct()
    return wide.join(own, [key, chapter], "left").select(key, chapter, F.coalesce("readonly", F.lit(True)).alias("readonly"))
