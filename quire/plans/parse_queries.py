"""Queries over the parser's tables and renderings of books with notes, nested spans, tables, sidebars and alternative numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import alignment, checking, markup
from quire.operators.windows import section_numbers
from quire.sources import files
from quire.sources.tables import table

#: A book in which @ stands for a name and # for a key.
BOOK = (
    "\\id TIT @\n\\mt1 Title\n\\c 1\n\\ca 2\\ca*\n\\cp A\n\\s Head\n\\p\n\\v 1 \\va 3\\va* First \\nd LORD\\nd* said\\f + \\fr 1:1 \\ft See \\fq this\\ft  or that\\f* so // then \\add one \\+nd two\\+nd* three\\add*.\n"
    "\\v 2 \\vp 2b\\vp* \\w @|lemma=\"#\" strong=\"G1\"\\w* \\jmp here|x\\jmp*\n\\tr \\th1 Day \\tcr2 Sum\n\\tr \\tc1 One \\tcr2 #\n\\q\n\\qt-s |sid=\"#\"\\*Speech\\qt-e\\*\n"
    "\\esb \\cat People\\cat*\n\\ms Who\n\\p @ was\n\\esbe\n\\p After\n\\c 2\n\\p\n\\v 1 Last \\zz odd\\zz* \\xyz-s\\*end\n"
)


def _books(spark, sf_dir):
    """A book for each nation."""
    n = table(spark, sf_dir, "nation")
    text = F.replace(F.replace(F.lit(BOOK), F.lit("@"), F.col("n_name")), F.lit("#"), F.col("n_nationkey").cast("string"))
    return n.select(F.col("n_nationkey").cast("long").alias("k"), text.alias("text"))


def rich_verses(spark, sf_dir):
    return markup.verse_texts(markup.nodes(_books(spark, sf_dir), "k", "text"), "k").select("k", "sid", "text")


def rich_numbers(spark, sf_dir):
    got = markup.numbers(markup.nodes(_books(spark, sf_dir), "k", "text"), "k")
    return got.select("k", "marker", "number", "alternative", "published")


def rich_usj(spark, sf_dir):
    """The whole JSON text of each book."""
    return markup.to_usj(markup.nodes(_books(spark, sf_dir), "k", "text"), "k")


def rich_xml(spark, sf_dir):
    """The whole XML text of each book."""
    return markup.to_usx(markup.to_usj(markup.nodes(_books(spark, sf_dir), "k", "text"), "k"), "k")


def rich_markers(spark, sf_dir):
    rows = markup.typed(markup.tokens(_books(spark, sf_dir), "k", "text"), "k")
    return markup.inferred_markers(rows, "k")


def rich_sidebars(spark, sf_dir):
    """Sidebars with the text that they hold."""
    node = markup.nodes(_books(spark, sf_dir), "k", "text")
    bars = markup.sidebars(node, "k").withColumnsRenamed({"k": "b", "first": "lo", "last": "hi"})
    inside = node.join(bars, (F.col("k") == F.col("b")) & F.col("pos").between(F.col("lo"), F.col("hi")))
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.trim("text").alias("t")))), lambda x: x["t"]), "|")
    return inside.groupBy("k", "category").agg(words.alias("text"))


def parse_log(spark, sf_dir):
    """What is odd in a book with faults, once for each nation."""
    n = table(spark, sf_dir, "nation")
    text = F.lit("\\id X\n\\c one\n\\p\n\\v 1 a\\nd* b \\f + \\ft open\n\\p\n\\v x \\b@d c\\newer n\\newer*")
    rows = markup.typed(markup.tokens(n.select(F.col("n_nationkey").cast("long").alias("k"), text.alias("text")), "k", "text"), "k")
    return markup.parse_log(rows, "k").select("k", F.col("pos").cast("long").alias("pos"), "level", "message")


def rule_breaches(spark, sf_dir):
    """Markers of the books whose white space isn't that of the rule that fits them best."""
    rows = markup.typed(markup.tokens(_books(spark, sf_dir), "k", "text"), "k")
    rules = spark.createDataFrame([("verse", "v", None, None, 9, " ", None), ("paragraphs", None, "paragraph", None, 5, "\n", None), ("chapter", "c", None, None, 9, "\n", " "), ("any", None, None, None, 1, None, None)], "name string, marker string, kind string, style string, priority int, before string, after string")
    got = markup.breaches(markup.matching_rules(rows, rules), "k")
    return got.groupBy("k", "rule").agg(F.count("*").alias("n"))


def section_counter(spark, sf_dir):
    """Events of a user as section markers: some stand alone, some start or end a section."""
    e = table(spark, sf_dir, "events")
    marker = F.get(F.array(*[F.lit(x) for x in ("ts", "ts-s", "ts-e")]), (F.col("event_id") % 7 % 3).cast("int"))
    return section_numbers(e.select("user_id", "event_id", marker.alias("marker")), ["user_id"], "event_id", "marker")


def checklist_instances(spark, sf_dir):
    """Templates as JSON made from regions and their nations."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    item = F.struct(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("label"))
    t = n.groupBy("r_name").agg(F.collect_list(item).alias("templateItems"))
    text = F.to_json(F.struct(F.lower("r_name").alias("id"), F.col("r_name").alias("label"), F.lit("term").alias("itemType"), "templateItems"))
    return checking.instantiate(t.select(text.alias("text")), "s1", "draft").select("session", "stage", "template", "label", "item_type", "item", "item_label", "status")


def stage_files(spark, sf_dir):
    """Workflows as JSON made from nations, read back: stages without an id or order are dropped."""
    n = table(spark, sf_dir, "nation")
    s = F.struct(F.when(F.col("n_nationkey") % 4 == 0, " ").otherwise(F.lower("n_name")).alias("id"), F.col("n_name").alias("label"), F.when(F.col("n_nationkey") % 5 > 0, F.col("n_nationkey") % 3).alias("order"))
    rows = n.groupBy("n_regionkey").agg(F.to_json(F.struct(F.collect_list(s).alias("stages"))).alias("text"))
    return checking.ordered_stages(checking.read_stages(rows, "n_regionkey", "text")).select("n_regionkey", "id", "label", F.col("order").cast("long").alias("place"))


def comment_files(spark, sf_dir):
    """Comment threads of suppliers written as JSON by nation and read back."""
    s = table(spark, sf_dir, "supplier")
    rows = s.select(F.lit("p").alias("project"), F.concat(F.lit("b"), F.col("s_nationkey").cast("string")).alias("book"), F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("ref"), (F.col("s_acctbal") > 0).alias("resolved"), F.array(F.struct(F.lit("me").alias("author"), F.col("s_name").alias("text"), F.lit("t").alias("timestamp"))).alias("comments"))
    made = checking.write_file(rows, ["project"], "threads")
    got = checking.read_threads(made, "project", "text")
    return got.select("book", "id", "ref", "resolved", F.get("comments", F.lit(0))["text"].alias("said"))


def alignment_documents(spark, sf_dir):
    """Order lines as alignment groups, written as JSON by order and read back."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").repartition("l_orderkey")
    lines = li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    src = F.array(F.struct(F.concat(F.lit("G"), F.col("l_partkey").cast("string")).alias("strong"), F.lit("l").alias("lemma"), F.lit("c").alias("content"), F.lit(1).alias("occurrence"), F.lit(1).alias("occurrences")))
    tgt = F.when(F.col("l_linenumber") < 7, F.array(F.struct(F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("word"), F.lit(1).alias("occurrence"), F.lit(2).alias("occurrences")))).otherwise(F.array())
    rows = lines.select(F.col("l_orderkey").alias("doc"), F.concat(F.lit("TIT 1:"), F.col("l_orderkey").cast("string")).alias("sid"), F.col("l_linenumber").alias("group"), src.alias("sources"), tgt.alias("targets"), F.lit("t").alias("translation"), F.lit("s").alias("source"))
    got = alignment.groups_json(files.write_alignment_json(rows, "doc", "translation", "source"), "text")
    return got.select("sid", F.col("group").cast("long").alias("group_no"), F.get("sources", F.lit(0))["strong"].alias("strong"), F.get("targets", F.lit(0))["word"].alias("word"))


QUERIES = {
    f.__name__: f
    for f in (rich_verses, rich_numbers, rich_usj, rich_xml, rich_markers, rich_sidebars, parse_log, rule_breaches, section_counter, checklist_instances, stage_files, comment_files, alignment_documents)
}

#: The tree of ``BOOK``.
TREE = (
    '{"type": "USJ", "version": "3.1", "content": [{"type": "book", "marker": "id", "code": "TIT", "content": ["@"]}, {"type": "para", "marker": "mt1", "content": ["Title"]}, '
    '{"type": "chapter", "marker": "c", "number": "1", "sid": "TIT 1", "altnumber": "2", "pubnumber": "A"}, {"type": "para", "marker": "s", "content": ["Head"]}, '
    '{"type": "para", "marker": "p", "content": [{"type": "verse", "marker": "v", "number": "1", "sid": "TIT 1:1", "altnumber": "3"}, " First ", {"type": "char", "marker": "nd", "content": ["LORD"]}, " said", '
    '{"type": "note", "marker": "f", "caller": "+", "content": [{"type": "char", "marker": "fr", "content": ["1:1 "]}, {"type": "char", "marker": "ft", "content": ["See "]}, {"type": "char", "marker": "fq", "content": ["this"]}, '
    '{"type": "char", "marker": "ft", "content": [" or that"]}]}, " so ", {"type": "optbreak"}, " then ", {"type": "char", "marker": "add", "content": ["one ", {"type": "char", "marker": "nd", "content": ["two"]}, " three"]}, ". ", '
    '{"type": "verse", "marker": "v", "number": "2", "sid": "TIT 1:2", "pubnumber": "2b"}, {"type": "char", "marker": "w", "lemma": "#", "strong": "G1", "content": ["@"]}, {"type": "char", "marker": "jmp", "link-href": "x", "content": ["here"]}]}, '
    '{"type": "table", "content": [{"type": "table:row", "marker": "tr", "content": [{"type": "table:cell", "marker": "th1", "align": "start", "content": ["Day "]}, {"type": "table:cell", "marker": "tcr2", "align": "end", "content": ["Sum "]}]}, '
    '{"type": "table:row", "marker": "tr", "content": [{"type": "table:cell", "marker": "tc1", "align": "start", "content": ["One "]}, {"type": "table:cell", "marker": "tcr2", "align": "end", "content": ["# "]}]}]}, '
    '{"type": "para", "marker": "q", "content": [{"type": "ms", "marker": "qt-s", "sid": "#"}, "Speech", {"type": "ms", "marker": "qt-e"}]}, '
    '{"type": "sidebar", "marker": "esb", "content": [{"type": "para", "marker": "ms", "content": ["Who"]}, {"type": "para", "marker": "p", "content": ["@ was"]}], "category": "People"}, {"type": "para", "marker": "p", "content": ["After"]}, '
    '{"type": "chapter", "marker": "c", "number": "2", "sid": "TIT 2"}, {"type": "para", "marker": "p", "content": [{"type": "verse", "marker": "v", "number": "1", "sid": "TIT 2:1"}, "Last ", {"type": "char", "marker": "zz", "content": ["odd"]}, '
    '{"type": "ms", "marker": "xyz-s"}, "end"]}]}'
)

#: The XML form of ``BOOK``.
XML = (
    '<?xml version="1.0" encoding="utf-8"?>\n<usx version="3.1"><book style="id" code="TIT">@</book><para style="mt1">Title</para><chapter style="c" number="1" sid="TIT 1" altnumber="2" pubnumber="A"/><para style="s">Head</para>'
    '<para style="p"><verse style="v" number="1" sid="TIT 1:1" altnumber="3"/> First <char style="nd">LORD</char> said<note style="f" caller="+"><char style="fr">1:1 </char><char style="ft">See </char><char style="fq">this</char>'
    '<char style="ft"> or that</char></note> so <optbreak/> then <char style="add">one <char style="nd">two</char> three</char>. <verse eid="TIT 1:1"/><verse style="v" number="2" sid="TIT 1:2" pubnumber="2b"/>'
    '<char style="w" lemma="#" strong="G1">@</char><char style="jmp" link-href="x">here</char></para><table><row style="tr"><cell style="th1" align="start">Day </cell><cell style="tcr2" align="end">Sum </cell></row>'
    '<row style="tr"><cell style="tc1" align="start">One </cell><cell style="tcr2" align="end"># </cell></row></table><para style="q"><ms style="qt-s" sid="#"/>Speech<ms style="qt-e"/></para>'
    '<sidebar style="esb" category="People"><para style="ms">Who</para><para style="p">@ was</para></sidebar><para style="p">After<verse eid="TIT 1:2"/></para><chapter eid="TIT 1"/><chapter style="c" number="2" sid="TIT 2"/>'
    '<para style="p"><verse style="v" number="1" sid="TIT 2:1"/>Last <char style="zz">odd</char><ms style="xyz-s"/>end<verse eid="TIT 2:1"/></para><chapter eid="TIT 2"/></usx>'
)

ORACLE_SQL = {
    "rich_verses": """
SELECT CAST(n_nationkey AS BIGINT) AS k, sid, replace(text, '@', n_name) AS text FROM nation, (VALUES ('TIT 1:1', 'First LORD said so // then one two three.'), ('TIT 1:2', '@ here Day Sum One ' || '#' || ' Speech People Who @ was After'), ('TIT 2:1', 'Last odd end')) v(sid, t),
LATERAL (SELECT replace(t, '#', CAST(n_nationkey AS VARCHAR)) AS text)""",
    "rich_numbers": """
SELECT CAST(n_nationkey AS BIGINT) AS k, marker, number, alternative, published FROM nation, (VALUES ('c', '1', '2', 'A'), ('v', '1', '3', NULL), ('v', '2', NULL, '2b'), ('c', '2', NULL, NULL), ('v', '1', NULL, NULL)) v(marker, number, alternative, published)""",
    "rich_usj": f"SELECT CAST(n_nationkey AS BIGINT) AS k, replace(replace('{TREE}', '@', n_name), '#', CAST(n_nationkey AS VARCHAR)) AS usj FROM nation",
    "rich_xml": f"SELECT CAST(n_nationkey AS BIGINT) AS k, replace(replace('{XML}', '@', n_name), '#', CAST(n_nationkey AS VARCHAR)) AS usx FROM nation",
    "rich_markers": """
SELECT CAST(n_nationkey AS BIGINT) AS k, marker, kind, 1::BIGINT AS n FROM nation, (VALUES ('zz', 'character'), ('xyz-s', 'milestone')) v(marker, kind)""",
    "rich_sidebars": "SELECT CAST(n_nationkey AS BIGINT) AS k, 'People' AS category, '|People||Who|' || n_name || ' was|' AS text FROM nation",
    "parse_log": """
SELECT CAST(n_nationkey AS BIGINT) AS k, pos, level, message FROM nation, (VALUES (1::BIGINT, 'error', '\\c: no number'), (4, 'warn', '\\nd*: nothing to close'), (5, 'warn', '\\f: note isn''t closed'), (8, 'error', '\\v: no number'),
  (9, 'error', '\\b@d: badly formed marker'), (9, 'warn', '\\b@d: unlisted marker taken as character'), (10, 'warn', '\\newer: unlisted marker taken as character')) v(pos, level, message)""",
    "rule_breaches": "SELECT CAST(n_nationkey AS BIGINT) AS k, 'verse' AS rule, 3::BIGINT AS n FROM nation",
    "section_counter": """
WITH e AS (SELECT user_id, event_id, ['ts', 'ts-s', 'ts-e'][CAST(event_id % 7 % 3 AS INT) + 1] AS marker FROM events),
n AS (SELECT *, count(*) FILTER (WHERE marker <> 'ts-e') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM e),
l AS (SELECT *, max(CASE WHEN marker <> 'ts' THEN r END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lr FROM n)
SELECT l.user_id, l.event_id, l.marker, CASE WHEN l.marker = 'ts-e' AND p.marker = 'ts-s' THEN p.c ELSE l.c END AS section FROM l LEFT JOIN n p ON p.user_id = l.user_id AND p.r = l.lr""",
    "checklist_instances": """
SELECT 's1' AS session, 'draft' AS stage, lower(r_name) AS template, r_name AS label, 'term' AS item_type, CAST(n_nationkey AS VARCHAR) AS item, n_name AS item_label, 'pending' AS status FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "stage_files": "SELECT n_regionkey, lower(n_name) AS id, n_name AS label, CAST(n_nationkey % 3 AS BIGINT) AS place FROM nation WHERE n_nationkey % 4 <> 0 AND n_nationkey % 5 > 0",
    "comment_files": "SELECT 'B' || s_nationkey AS book, CAST(s_suppkey AS VARCHAR) AS id, s_name AS ref, s_acctbal > 0 AS resolved, s_name AS said FROM supplier",
    "alignment_documents": """
WITH l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS g FROM l)
SELECT 'TIT 1:' || l_orderkey AS sid, g AS group_no, 'G' || p AS strong, 'w' || p AS word FROM n WHERE l_linenumber < 7""",
}
