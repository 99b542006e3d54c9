"""Queries over tree tables: numbers of nodes, spans, books from XML and from JSON, operations on trees."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import escape_xml, strip_edges
from quire.operators import alignment, markup, ranges, tree_edits, trees
from quire.operators.tokens import token_table
from quire.sources import files
from quire.sources.tables import table
from quire.streaming import sync, windows


def _lines(spark, sf_dir):
    """(doc_id, n, line): the lines of documents that hold a letter or digit, from 1, with runs of anything else as one space."""
    d = table(spark, sf_dir, "documents")
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}.,&<]+", " "))), lambda x: x != "")
    return d.select("doc_id", F.posexplode(lines).alias("n", "line")).withColumn("n", F.col("n") + 1)


def _joined(rows, piece, head, tail):
    """(doc_id, text): each document's pieces in order of n, between ``head`` and ``tail``."""
    parts = F.array_sort(F.collect_list(F.struct("n", piece.alias("t"))))
    made = rows.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("t"))
    return made.select("doc_id", F.concat(head, "t", tail).alias("text"))


def _three(first, second, third):
    """By the line's number: a paragraph of text, one with nested spans, one with a note."""
    n = F.col("n") % 3
    return F.when(n == 1, first).when(n == 2, second).otherwise(third)


def _tagged_books(spark, sf_dir):
    n, line = F.col("n").cast("string"), F.col("line")
    verse = lambda p: F.concat(F.lit(f"\\{p}\n\\v "), n, F.lit(" "))
    piece = _three(F.concat(verse("p"), line), F.concat(verse("q1"), F.lit("\\add "), line, F.lit(' \\nd x\\nd*\\add*\\w y|lemma="'), n, F.lit('"\\w*')), F.concat(verse("m"), line, F.lit("\\f + \\fr 1.1 \\ft "), line, F.lit("\\f*")))
    return _joined(_lines(spark, sf_dir), F.concat(piece, F.lit("\n")), F.concat(F.lit("\\id D"), F.col("doc_id").cast("string"), F.lit("\n\\c 1\n")), F.lit(""))


def _xml_books(spark, sf_dir):
    n, line = F.col("n").cast("string"), escape_xml(F.col("line"))
    verse = lambda p: F.concat(F.lit(f'<para style="{p}"><verse number="'), n, F.lit('" style="v"/>'))
    second = F.concat(verse("q1"), F.lit('<char style="add">'), line, F.lit(' <char style="nd">x</char></char><char style="w" lemma="'), n, F.lit('">y</char>'))
    third = F.concat(verse("m"), line, F.lit('<note style="f" caller="-"><char style="ft">'), line, F.lit('</char></note><table><row style="tr"><cell style="tc1" colspan="2">a &gt; b</cell></row></table>'))
    piece = F.concat(_three(F.concat(verse("p"), line), second, third), F.lit("</para>\n"))
    head = F.concat(F.lit('<?xml version="1.0"?>\n<!-- a <book> --><usx version="3.1"><book code="D'), F.col("doc_id").cast("string"), F.lit('" style="id"/><chapter number="1" style="c"/>'))
    return _joined(_lines(spark, sf_dir), piece, head, F.lit('<chapter eid="D 1"/></usx>'))


def tree_numbers(spark, sf_dir):
    """Lines of documents as an outline, each as deep as its length asks for and the line before allows."""
    rows = _lines(spark, sf_dir).withColumn("wish", F.when(F.col("n") == 1, 0).otherwise(F.length("line") % 5))
    low = F.min(F.col("wish") - F.col("n")).over(W.partitionBy("doc_id").orderBy("n").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.select("doc_id", F.col("n").alias("pos"), (F.col("n") + low).alias("level"))
    long = lambda c: F.col(c).cast("long").alias(c)
    return trees.nested_sets(rows, "doc_id").select("doc_id", *[long(c) for c in ("pos", "level", "parent", "idx", "last")])


def tree_spans(spark, sf_dir):
    """Order lines as trees: an order over its odd lines, an odd line over the even one after it. Even lines have spans, so have the
    odd ones whose quantity is above 45."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").cast("long").alias("p"), F.min("l_quantity").cast("long").alias("q"))
    own = (F.col("l_linenumber") % 2 == 0) | (F.col("q") > 45)
    lines = li.select("l_orderkey", F.col("l_linenumber").cast("int").alias("pos"), (2 - F.col("l_linenumber") % 2).cast("int").alias("level"), F.when(own, F.col("p")).alias("start"), F.when(own, F.col("p") + F.col("q")).alias("end"))
    # an even line without the odd one before it hangs below the order
    before = F.lag("pos").over(W.partitionBy("l_orderkey").orderBy("pos"))
    lines = lines.withColumn("level", F.when(F.col("level") == 2, F.when(before == F.col("pos") - 1, 2).otherwise(1)).otherwise(1))
    null = F.lit(None).cast("long")
    roots = li.select("l_orderkey").distinct().select("l_orderkey", F.lit(0).alias("pos"), F.lit(0).alias("level"), null.alias("start"), null.alias("end"))
    return trees.spread_spans(roots.unionByName(lines), "l_orderkey").select("l_orderkey", F.col("pos").cast("long").alias("pos"), "start", "end")


def xml_books(spark, sf_dir):
    """Documents as XML books with nested spans, attributes, notes and tables, read to tagged text."""
    books = files.read_usx(_xml_books(spark, sf_dir), "doc_id", "text")
    return books.select("doc_id", F.length("text").cast("long").alias("chars"), F.md5("text").alias("text"))


def tagged_round_trip(spark, sf_dir):
    """Tagged books to JSON trees, to tagged text and to JSON trees again: the nodes of the second trees."""
    trip = lambda books: markup.to_usj(markup.nodes(books, "doc_id", "text"), "doc_id")
    once = trees.to_tagged(trees.read_json(trip(_tagged_books(spark, sf_dir)), "doc_id", "usj"), "doc_id")
    rows = trees.read_json(trip(once), "doc_id", "usj")
    at = lambda c: F.element_at("attrs", F.lit(c)).alias(c)
    long = lambda c: F.col(c).cast("long").alias(c)
    return rows.select("doc_id", *[long(c) for c in ("pos", "level", "idx", "last")], "name", at("style"), at("number"), at("lemma"), at("caller"), "text")


def _paragraphs(rows):
    """(doc_id, chapter, path, name, attrs, text, holds): lines (doc_id, n, name, a, line) as paragraphs of a text and, where the line
    is long, a span of it; ten lines a chapter."""
    node = lambda path, name, attrs, text, holds: F.struct(path.alias("path"), F.lit(name).cast("string").alias("name") if not hasattr(name, "alias") else name.alias("name"), attrs.alias("attrs"), text.alias("text"), F.lit(holds).alias("holds"))
    place = ((F.col("n") - 1) % 10).cast("int")
    none, null = F.create_map().cast("map<string,string>"), F.lit(None).cast("string")
    at = lambda *more: F.array(place, *[F.lit(x) for x in more])
    span = F.when(F.length("line") > 40, F.array(node(at(1), "char", none, null, True), node(at(1, 0), None, none, F.col("line"), False)))
    parts = F.concat(F.array(node(at(), F.col("name"), F.create_map(F.lit("sid"), F.col("a")), null, True), node(at(0), None, none, F.col("line"), False)), F.coalesce(span, F.array()))
    chapter = (F.floor((F.col("n") - 1) / 10) + 1).cast("int")
    return rows.select("doc_id", chapter.alias("chapter"), F.explode(parts).alias("p")).select("doc_id", "chapter", "p.*")


def _told(nodes):
    return nodes.select("doc_id", F.col("chapter").cast("long").alias("chapter"), F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"), "name", F.element_at("attrs", F.lit("sid")).alias("sid"), "text", "holds")


def tree_diff_applied(spark, sf_dir):
    """Two versions of documents as chapters of paragraphs, the second with other texts, other paragraphs, fewer and more lines in a
    chapter; the first one after the operations that turn it into the second."""
    lines = _lines(spark, sf_dir).withColumn("a", F.col("n").cast("string"))
    old = lines.withColumn("name", F.lit("p"))
    n, size = F.col("n"), F.length("line")
    kind = F.when(size % 5 == 0, "q").otherwise("p")
    text = F.when(size % 3 == 0, F.concat("line", F.lit(" new"))).when(size % 7 == 0, F.substr("line", F.lit(1), F.lit(30))).otherwise(F.col("line"))
    new = lines.withColumns({"name": kind, "line": text}).where((n % 10 != 0) | (F.col("doc_id") % 2 == 0))
    old = old.where((n % 10 != 9) & (n % 10 != 0) | (F.col("doc_id") % 3 > 0))
    a, b = _paragraphs(old), _paragraphs(new)
    ops = tree_edits.diff_trees(a, b, ["doc_id"], "chapter")
    # an inner join: a semi join would go below the windows, to nodes that have been dealt already
    return _told(tree_edits.apply_tree_ops(a, ops, ["doc_id", "chapter"]).join(b.select("doc_id", "chapter").distinct(), ["doc_id", "chapter"]))


def tree_ops_applied(spark, sf_dir):
    """Six operations of each kind on every chapter of five lines or more: a move, a removal, an insertion, an attribute, a text inside a
    paragraph and a replacement."""
    lines = _lines(spark, sf_dir).withColumns({"a": F.col("n").cast("string"), "name": F.lit("p")})
    nodes = _paragraphs(lines)
    chapters = nodes.where("size(path) = 1").groupBy("doc_id", "chapter").agg(F.count("*").alias("n")).where("n > 4")
    made = lambda name: F.array(F.struct(F.array().cast("array<int>").alias("path"), F.lit(name).alias("name"), F.create_map(F.lit("sid"), F.lit("new")).alias("attrs"), F.lit(None).cast("string").alias("text"), F.lit(True).alias("holds")), F.struct(F.array(F.lit(0)).alias("path"), F.lit(None).cast("string").alias("name"), F.create_map().cast("map<string,string>").alias("attrs"), F.lit("made").alias("text"), F.lit(False).alias("holds")))
    op = lambda seq, kind, path, to=None, attr=None, value=None, node=None: F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("op"), F.array(*map(F.lit, path)).alias("path"), (F.array(*map(F.lit, to)) if to else F.lit(None).cast("array<int>")).alias("to"), F.lit(attr).cast("string").alias("attr"), F.lit(value).cast("string").alias("value"), (node if node is not None else F.lit(None)).cast(tree_edits.SUBTREE).alias("node"))
    todo = F.array(op(0, "moveNode", [0], [2]), op(1, "removeNode", [1]), op(2, "insertNode", [1], node=made("q")), op(3, "setAttr", [0], attr="sid", value="set"), op(4, "setText", [0, 0], value="said"), op(5, "replaceNode", [2], node=made("m")))
    ops = chapters.select("doc_id", "chapter", F.explode(todo).alias("o")).select("doc_id", "chapter", "o.*")
    return _told(tree_edits.apply_tree_ops(nodes, ops, ["doc_id", "chapter"]))


def stream_merged(spark, sf_dir):
    """Each user's events as a document that two replicas edit: one has an insertion pending, the other's entries come as a stream and
    each of them twice; every tenth document has alignments only."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("doc"), "user_id", "event_id")
    op = lambda place: F.array(F.struct(F.lit("insertNode").alias("op"), F.array(place.cast("int")).alias("path"), F.lit(None).cast("array<int>").alias("to"), F.lit(None).cast("string").alias("attr"), F.lit("x").alias("value"), F.lit(None).cast("string").alias("old")))
    sequence = F.row_number().over(W.partitionBy("doc").orderBy("event_id")).cast("long")
    layer = F.when(F.col("user_id") % 10 == 0, "alignment").otherwise("content")
    other = e.withColumn("sequence", sequence).select("doc", F.lit(1).alias("chapter"), F.lit("b").alias("user"), "sequence", layer.alias("layer"), op(3 * F.col("sequence")).alias("ops"))
    mine = e.where("user_id % 3 > 0").select("doc").distinct().select("doc", F.lit(1).alias("chapter"), F.lit("a").alias("user"), F.lit(1).cast("long").alias("sequence"), F.lit("content").alias("layer"), op(F.lit(5)).alias("ops"))
    folder = windows.folder(spark, "entries")
    mine.unionByName(other).unionByName(other).write.parquet(folder)
    sync.use_rocks(spark)
    stream = spark.readStream.schema(mine.schema).parquet(folder)
    got = windows.run_once(sync.merge_entries(stream, "a"), windows.folder(spark, "merged"))
    return got.select("doc", "user", "sequence", "status", F.get(F.get("ops", F.lit(0))["path"], F.lit(0)).cast("long").alias("place"), "pending")


def nested_groups(spark, sf_dir):
    """Benchmark items as verses with three alignment groups: one over another, and one that in every third item crosses them."""
    items = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id")
    tokens = token_table(items, "doc_id", "text").select("doc_id", "idx", "surface").where("idx < 9")
    slot = alignment.numbered(tokens, ["doc_id"], "surface", "idx").withColumn("occurrences", F.count("*").over(W.partitionBy("doc_id", "norm")))
    far = F.when(F.col("doc_id") % 3 == 0, 3).otherwise(6)
    group = F.when(F.col("idx").isin(0, 4), 1).when(F.col("idx").isin(1, 2), 2).when(F.col("idx").isin(far, F.lit(7)), 3)
    targets = slot.withColumn("group", group).where("group IS NOT NULL").select("doc_id", "group", F.col("norm").alias("word"), F.col("slot").alias("occurrence"), "occurrences")
    number = F.explode(F.when(F.col("group") == 2, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    sources = targets.select("doc_id", "group").distinct().withColumn("n", number).select("doc_id", "group", "n", F.create_map(F.lit("strong"), F.concat(F.lit("G"), F.col("group").cast("string"), F.col("n").cast("string")), F.lit("content"), F.lit("c")).alias("attrs"))
    return alignment.emit_groups(tokens, sources, targets, ["doc_id"], "idx", "surface")


def verses_of_ranges(spark, sf_dir):
    """Order lines as references of five forms, with how many of a book's verses each has: four chapters of ten verses."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    c, v = (F.col("p") % 4 + 1).cast("string"), (F.col("s") % 12).cast("string")
    book = F.concat(F.lit("B"), F.lpad((F.col("l_orderkey") % 50).cast("string"), 2, "0"), F.lit(" "))
    forms = [F.concat(c, F.lit(":"), v), F.concat(c, F.lit(":"), v, F.lit(" – 8")), c, F.concat(c, F.lit("-3")), F.concat(c, F.lit(":"), v, F.lit("-3:4"))]
    ref = F.concat(book, F.get(F.array(*forms), (F.col("l_linenumber") % 5).cast("int")))
    li = li.select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), ref.alias("ref"))
    rows = ranges.read_ranges(li.select("ref").distinct(), "ref")  # many lines have the same reference
    books = rows.where("book IS NOT NULL").select("book").distinct()
    verses = books.withColumn("chapter", F.explode(F.array(*map(F.lit, range(1, 5))))).withColumn("verse", F.explode(F.array(*map(F.lit, range(1, 11)))))
    place = lambda c: (F.col(f"{c}.chapter") * 100 + F.col(f"{c}.verse")).cast("long").alias(c)
    return li.join(ranges.verse_counts(rows, verses), "ref").select("l_orderkey", "line", "ref", "n", place("first"), place("last"))


QUERIES = {f.__name__: f for f in (tree_numbers, tree_spans, xml_books, tagged_round_trip, tree_diff_applied, tree_ops_applied, stream_merged, nested_groups, verses_of_ranges)}

_LINES = r"""l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[^\p{L}\p{N}.,&<]+', ' ', 'g'))), lambda x: x <> '') AS a FROM documents),
x AS (SELECT doc_id, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS n FROM l)"""

ORACLE_SQL = {
    "tree_numbers": f"""
WITH {_LINES},
w AS (SELECT doc_id, n, CASE n WHEN 1 THEN 0 ELSE length(line) % 5 END AS wish FROM x),
t AS (SELECT doc_id, n AS pos, n + min(wish - n) OVER (PARTITION BY doc_id ORDER BY n) AS level, max(n) OVER (PARTITION BY doc_id) AS top FROM w),
p AS (SELECT t.*, (SELECT max(q.pos) FROM t q WHERE q.doc_id = t.doc_id AND q.pos < t.pos AND q.level = t.level - 1) AS parent,
  coalesce((SELECT min(q.pos) - 1 FROM t q WHERE q.doc_id = t.doc_id AND q.pos > t.pos AND q.level <= t.level), top) AS last FROM t)
SELECT doc_id, pos, CAST(level AS BIGINT) AS level, parent, row_number() OVER (PARTITION BY doc_id, parent ORDER BY pos) - 1 AS idx, last FROM p""",
    "tree_spans": """
WITH li AS (SELECT l_orderkey, l_linenumber AS n, CAST(min(l_partkey) AS BIGINT) AS p, CAST(min(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2),
o AS (SELECT *, CASE WHEN n % 2 = 0 OR q > 45 THEN p END AS s, CASE WHEN n % 2 = 0 OR q > 45 THEN p + q END AS e FROM li),
c AS (SELECT a.l_orderkey, a.n, coalesce(a.s, CASE WHEN a.n % 2 = 1 THEN b.s END) AS s, coalesce(a.e, CASE WHEN a.n % 2 = 1 THEN b.e END) AS e,
  a.n % 2 = 1 OR d.n IS NULL AS high FROM o a LEFT JOIN o b ON b.l_orderkey = a.l_orderkey AND b.n = a.n + 1 LEFT JOIN o d ON d.l_orderkey = a.l_orderkey AND d.n = a.n - 1)
SELECT l_orderkey, CAST(n AS BIGINT) AS pos, s AS start, e AS "end" FROM c UNION ALL SELECT l_orderkey, 0, min(s) FILTER (high), max(e) FILTER (high) FROM c GROUP BY 1""",
    "xml_books": rf"""
WITH {_LINES},
m AS (SELECT doc_id, '\id D' || doc_id || ' ' || chr(10) || '\c 1' || chr(10) || string_agg(CASE n % 3 WHEN 1 THEN '\p \v ' || n || ' ' || line || chr(10)
  WHEN 2 THEN '\q1 \v ' || n || ' \add ' || line || ' \nd x\nd*\add*\w y|lemma="' || n || '"\w*' || chr(10)
  ELSE '\m \v ' || n || ' ' || line || '\f - \ft ' || line || '\ft*\f*\tr \tc1-2 a > b' || chr(10) || chr(10) END, chr(10) ORDER BY n) AS text FROM x GROUP BY doc_id)
SELECT doc_id, CAST(length(rtrim(text, chr(10))) AS BIGINT) AS chars, md5(rtrim(text, chr(10))) AS text FROM m""",
    "tagged_round_trip": f"""
WITH {_LINES},
p AS (SELECT doc_id, n, unnest(CASE n % 3 WHEN 1 THEN [
    {{'level': 1, 'idx': n + 1, 'size': 2, 'name': 'para', 'style': 'p', 'text': NULL}}, {{'level': 2, 'idx': 0, 'size': 0, 'name': 'verse', 'style': 'v', 'text': NULL}}, {{'level': 2, 'idx': 1, 'size': 0, 'name': NULL, 'style': NULL, 'text': line}}]
  WHEN 2 THEN [
    {{'level': 1, 'idx': n + 1, 'size': 7, 'name': 'para', 'style': 'q1', 'text': NULL}}, {{'level': 2, 'idx': 0, 'size': 0, 'name': 'verse', 'style': 'v', 'text': NULL}}, {{'level': 2, 'idx': 1, 'size': 3, 'name': 'char', 'style': 'add', 'text': NULL}},
    {{'level': 3, 'idx': 0, 'size': 0, 'name': NULL, 'style': NULL, 'text': line || ' '}}, {{'level': 3, 'idx': 1, 'size': 1, 'name': 'char', 'style': 'nd', 'text': NULL}}, {{'level': 4, 'idx': 0, 'size': 0, 'name': NULL, 'style': NULL, 'text': 'x'}},
    {{'level': 2, 'idx': 2, 'size': 1, 'name': 'char', 'style': 'w', 'text': NULL}}, {{'level': 3, 'idx': 0, 'size': 0, 'name': NULL, 'style': NULL, 'text': 'y'}}]
  ELSE [
    {{'level': 1, 'idx': n + 1, 'size': 7, 'name': 'para', 'style': 'm', 'text': NULL}}, {{'level': 2, 'idx': 0, 'size': 0, 'name': 'verse', 'style': 'v', 'text': NULL}}, {{'level': 2, 'idx': 1, 'size': 0, 'name': NULL, 'style': NULL, 'text': line}},
    {{'level': 2, 'idx': 2, 'size': 4, 'name': 'note', 'style': 'f', 'text': NULL}}, {{'level': 3, 'idx': 0, 'size': 1, 'name': 'char', 'style': 'fr', 'text': NULL}}, {{'level': 4, 'idx': 0, 'size': 0, 'name': NULL, 'style': NULL, 'text': '1.1 '}},
    {{'level': 3, 'idx': 1, 'size': 1, 'name': 'char', 'style': 'ft', 'text': NULL}}, {{'level': 4, 'idx': 0, 'size': 0, 'name': NULL, 'style': NULL, 'text': line}}] END) AS r,
  unnest(range(CASE n % 3 WHEN 1 THEN 3 ELSE 8 END)) AS j FROM x),
q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n, j) + 2 AS pos FROM p),
d AS (SELECT doc_id, count(*) AS c FROM p GROUP BY 1)
SELECT doc_id, pos, CAST(r.level AS BIGINT) AS level, CAST(r.idx AS BIGINT) AS idx, pos + r.size AS last, r.name, r.style, CASE r.style WHEN 'v' THEN CAST(n AS VARCHAR) END AS number,
  CASE r.style WHEN 'w' THEN CAST(n AS VARCHAR) END AS lemma, CASE r.style WHEN 'f' THEN '+' END AS caller, r.text FROM q
UNION ALL SELECT doc_id, 0, 0, 0, c + 2, 'USJ', NULL, NULL, NULL, NULL, NULL FROM d
UNION ALL SELECT doc_id, 1, 1, 0, 1, 'book', 'id', NULL, NULL, NULL, NULL FROM d
UNION ALL SELECT doc_id, 2, 1, 1, 2, 'chapter', 'c', '1', NULL, NULL, NULL FROM d""",
    "tree_diff_applied": f"""
WITH {_LINES},
v AS (SELECT doc_id, n, CASE WHEN length(line) % 5 = 0 THEN 'q' ELSE 'p' END AS name, CASE WHEN length(line) % 3 = 0 THEN line || ' new' WHEN length(line) % 7 = 0 THEN substr(line, 1, 30) ELSE line END AS t FROM x WHERE n % 10 <> 0 OR doc_id % 2 = 0),
o AS (SELECT doc_id, n, line FROM x WHERE n % 10 NOT IN (0, 9) OR doc_id % 3 > 0),
c AS (SELECT DISTINCT doc_id, (n - 1) // 10 AS c FROM o),
p AS (SELECT v.doc_id, (v.n - 1) // 10 + 1 AS chapter, (v.n - 1) % 10 AS i, v.name, CAST(v.n AS VARCHAR) AS a, t FROM v JOIN c ON c.doc_id = v.doc_id AND c.c = (v.n - 1) // 10)
SELECT doc_id, chapter, CAST(i AS VARCHAR) AS path, name, a AS sid, NULL AS text, true AS holds FROM p
UNION ALL SELECT doc_id, chapter, i || '/0', NULL, NULL, t, false FROM p
UNION ALL SELECT doc_id, chapter, i || '/1', 'char', NULL, NULL, true FROM p WHERE length(t) > 40
UNION ALL SELECT doc_id, chapter, i || '/1/0', NULL, NULL, t, false FROM p WHERE length(t) > 40""",
    "tree_ops_applied": f"""
WITH {_LINES},
p AS (SELECT doc_id, (n - 1) // 10 + 1 AS chapter, (n - 1) % 10 AS i, CAST(n AS VARCHAR) AS a, line FROM x),
s AS (SELECT *, count(*) OVER (PARTITION BY doc_id, chapter) > 4 AS big FROM p),
m AS (SELECT doc_id, chapter, big, CASE WHEN NOT big THEN i WHEN i = 1 THEN 0 ELSE i END AS i, CASE WHEN big AND i = 1 THEN 'set' ELSE a END AS a, CASE WHEN big AND i = 1 THEN 'said' ELSE line END AS t, line FROM s WHERE NOT big OR i NOT IN (0, 2)),
n AS (SELECT DISTINCT doc_id, chapter, k AS i, v AS name FROM s, (VALUES (1, 'q'), (2, 'm')) w(k, v) WHERE big)
SELECT doc_id, chapter, CAST(i AS VARCHAR) AS path, 'p' AS name, a AS sid, NULL AS text, true AS holds FROM m
UNION ALL SELECT doc_id, chapter, i || '/0', NULL, NULL, t, false FROM m
UNION ALL SELECT doc_id, chapter, i || '/1', 'char', NULL, NULL, true FROM m WHERE length(line) > 40
UNION ALL SELECT doc_id, chapter, i || '/1/0', NULL, NULL, line, false FROM m WHERE length(line) > 40
UNION ALL SELECT doc_id, chapter, CAST(i AS VARCHAR), name, 'new', NULL, true FROM n
UNION ALL SELECT doc_id, chapter, i || '/0', NULL, NULL, 'made', false FROM n""",
    "stream_merged": """
WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events),
o AS (SELECT user_id, s, user_id % 10 = 0 AS other, user_id % 3 > 0 AS mine FROM e)
SELECT CAST(user_id AS VARCHAR) AS doc, 'b' AS "user", s AS sequence, CASE WHEN other THEN 'recorded' ELSE 'merged' END AS status,
  CASE WHEN NOT other THEN 3 * s + CASE WHEN mine AND s > 1 THEN 1 ELSE 0 END END AS place, CASE WHEN mine THEN 1::BIGINT ELSE 0 END AS pending FROM o
UNION ALL SELECT DISTINCT CAST(user_id AS VARCHAR), 'a', 1, 'local', 5, 1 FROM o WHERE mine""",
    "verses_of_ranges": """
WITH li AS (SELECT l_orderkey, l_linenumber AS line, min(l_partkey) % 4 + 1 AS c, min(l_suppkey) % 12 AS v FROM lineitem GROUP BY 1, 2),
r AS (SELECT l_orderkey, CAST(line AS BIGINT) AS line, 'B' || lpad(CAST(l_orderkey % 50 AS VARCHAR), 2, '0') || ' ' || CASE line % 5 WHEN 0 THEN c || ':' || v WHEN 1 THEN c || ':' || v || ' – 8' WHEN 2 THEN CAST(c AS VARCHAR) WHEN 3 THEN c || '-3' ELSE c || ':' || v || '-3:4' END AS ref,
  CASE line % 5 WHEN 2 THEN c * 100 WHEN 3 THEN c * 100 ELSE c * 100 + v END AS lo, CASE line % 5 WHEN 0 THEN c * 100 + v WHEN 1 THEN c * 100 + 8 WHEN 2 THEN c * 100 + 99 WHEN 3 THEN 399 ELSE 304 END AS hi FROM li),
v AS (SELECT c * 100 + v AS x FROM range(1, 5) a(c), range(1, 11) b(v))
SELECT l_orderkey, line, ref, count(*) AS n, min(x) AS first, max(x) AS last FROM r JOIN v ON x BETWEEN lo AND hi GROUP BY ALL""",
    "nested_groups": r"""
WITH w AS (SELECT item_id AS doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')[1:9] AS a FROM benchmark),
t AS (SELECT doc_id, unnest(a) AS s, unnest(range(len(a))) AS i, len(a) AS n FROM w),
c AS (SELECT *, regexp_replace(s, '^[^\p{L}\p{N}''’]+|[^\p{L}\p{N}''’]+$', '', 'g') AS core FROM t),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, core ORDER BY i) AS occ, count(*) OVER (PARTITION BY doc_id, core) AS occs, doc_id % 3 = 0 AND n > 3 AND n > 7 AS crossed FROM c),
g AS (SELECT *, i IN (0, 1, 2, 4, 6, 7) AS held FROM o),
p AS (SELECT doc_id, i, crossed, CASE WHEN crossed OR NOT held AND doc_id % 3 > 0 OR doc_id % 3 = 0 AND i NOT IN (0, 1, 2, 3, 4, 7) THEN s ELSE
  CASE i WHEN 0 THEN '\zaln-s |x-content="c" x-strong="G11"\*' WHEN 1 THEN '\zaln-s |x-content="c" x-strong="G21"\*\zaln-s |x-content="c" x-strong="G22"\*' ELSE '' END
  || CASE WHEN doc_id % 3 > 0 AND (i = 6 OR i = 7 AND n <= 6) OR doc_id % 3 = 0 AND i = 3 THEN '\zaln-s |x-content="c" x-strong="G31"\*' ELSE '' END
  || substr(s, 1, position(core IN s) - 1) || '\w ' || core || '|x-occurrence="' || occ || '" x-occurrences="' || occs || '"\w*' || substr(s, position(core IN s) + length(core))
  || CASE WHEN i = 2 THEN '\zaln-e\*\zaln-e\*' WHEN i = 4 THEN '\zaln-e\*' WHEN i = 7 OR i = 6 AND n = 7 OR doc_id % 3 = 0 AND i = 3 AND n <= 7 THEN '\zaln-e\*' ELSE '' END END AS piece FROM g)
SELECT doc_id, string_agg(piece, ' ' ORDER BY i) AS text, NOT bool_or(crossed) AS rebuilt FROM p GROUP BY doc_id""",
}
