"""Queries that write tables in a text format, read them back, and compare."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import alignment, markup, similarity
from quire.operators.tokens import token_table, with_occurrence
from quire.sources import files
from quire.sources.tables import table
from quire.streaming import windows as stream


def _lines_of(rows, key, order, line):
    """(key, text): one text for each key, its lines in order."""
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("__l")))), lambda x: x["__l"]), "\n").alias("text"))


def help_table(spark, sf_dir):
    """Parts as notes of their brand's table, read back with reference, occurrence and link."""
    p = table(spark, sf_dir, "part")
    cells = [F.concat((F.col("p_size") % 5).cast("string"), F.lit(":"), F.col("p_partkey").cast("string")), F.col("p_partkey").cast("string"), F.lit(""), F.concat(F.lit("rc://*/ta/man/translate/"), F.replace(F.lower("p_type"), F.lit(" "), F.lit("-"))), F.col("p_name"), F.when(F.col("p_size") % 3 == 0, "").otherwise((F.col("p_size") % 4).cast("string")), F.lit("note")]
    body = _lines_of(p, "p_brand", ["p_partkey"], F.concat_ws("\t", *cells))
    whole = body.select("p_brand", F.concat(F.lit("Reference\tID\tTags\tSupportReference\tQuote\tOccurrence\tNote\n"), "text").alias("text"))
    got = files.read_notes(whole, "p_brand", "text")
    return got.select("p_brand", "id", F.col("ref.chapter").cast("long").alias("chapter"), F.col("ref.verse").cast("long").alias("verse"), F.col("occurrence").cast("long").alias("occurrence"), F.col("link.type").alias("link_type"), F.col("link.id").alias("link_id"), "quote")


def journal_lines(spark, sf_dir):
    """Events of each user as a journal file with a header and a broken line, read back."""
    e = table(spark, sf_dir, "events")
    line = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("userId"), F.col("event_id").alias("sequence"), F.col("event_type").alias("layer")))
    text = _lines_of(e, "user_id", ["event_id"], line).select("user_id", F.concat(F.lit('{"_journalHeader":1,"vectorClock":{}}\n{broken\n\n'), "text").alias("text"))
    got = files.read_journal(text, "user_id", "text")
    return got.select("user_id", "id", "sequence", "layer")


def alignment_lines(spark, sf_dir):
    """Order lines as alignment rows of two words each, read from tab-separated text and written again."""
    li = table(spark, sf_dir, "lineitem").where("l_linenumber IS NOT NULL")
    cells = [F.lit("TIT"), F.col("l_linenumber").cast("string"), F.col("l_orderkey").cast("string"), F.concat("l_returnflag", F.lit("+"), "l_linestatus"), F.lit("1/1+1/2"), F.lit("G1+G2"), F.concat(F.lit("w"), F.col("l_partkey").cast("string")), F.concat(F.col("l_linenumber").cast("string"), F.lit("/7")), F.lit("l"), F.lit("m")]
    rows = li.select("l_orderkey", "l_linenumber", F.concat_ws("\t", *cells).alias("line"))
    text = _lines_of(rows, "l_orderkey", ["l_linenumber"], F.col("line"))
    got = files.read_alignment_tsv(text, "l_orderkey", "text")
    flat = {"second_source": F.get("sources", F.lit(1))["word"], "target": F.get("targets", F.lit(0))["word"], "occurrence": F.get("targets", F.lit(0))["occurrence"].cast("long")}
    return files.write_alignment_tsv(got.withColumns(flat), ("sid", *flat))


def alignment_sections(spark, sf_dir):
    c = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    line = F.concat(F.lit("== "), "n_name", F.lit(" ==\n"), "r_name", F.lit(" → "), "n_name", F.lit(" x"))
    text = _lines_of(c, "r_regionkey", ["n_nationkey"], line)
    got = files.read_alignment_text(text, "r_regionkey", "text")
    return got.select("sid", F.array_join("sources", "|").alias("sources"), F.array_join("targets", "|").alias("targets"))


def usx_import(spark, sf_dir):
    """Documents as XML books, one verse a line, read back to verses."""
    d = table(spark, sf_dir, "documents")
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    verses = F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit('<verse number="'), (i + 1).cast("string"), F.lit('" style="v"/>'), F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")))), "\n")
    xml = F.concat(F.lit('<usx version="3.0"><book code="D'), F.col("doc_id").cast("string"), F.lit('" style="id"></book><chapter number="1" style="c"/><para style="p">'), verses, F.lit("</para></usx>"))
    books = files.read_usx(d.select("doc_id", xml.alias("xml")), "doc_id", "xml")
    return markup.verse_texts(markup.nodes(books, "doc_id", "text"), "doc_id").select("doc_id", "sid", F.md5("text").alias("text"))


def _aligned(spark, sf_dir):
    """Benchmark items as verses in which every third word is aligned, and (item_id, idx, surface, occurrence)."""
    docs = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id")
    words = with_occurrence(token_table(docs, "doc_id", "text"), "doc_id")
    return docs, words


def alignment_groups(spark, sf_dir):
    docs, words = _aligned(spark, sf_dir)
    one = F.when(F.col("idx") % 3 == 0, F.concat(F.lit('\\zaln-s |x-strong="G'), F.col("idx").cast("string"), F.lit('" x-content="c"\\*\\w '), "surface", F.lit('|x-occurrence="'), F.col("occurrence").cast("string"), F.lit('"\\w*\\zaln-e\\*'))).otherwise(F.concat(F.lit("\\w "), "surface", F.lit("\\w*")))
    text = words.groupBy("doc_id").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("idx", one.alias("t")))), lambda x: x["t"])).alias("t"))
    books = text.select("doc_id", F.concat(F.lit("\\id B"), F.col("doc_id").cast("string"), F.lit("\n\\c 1\n\\p\n\\v 1 "), "t").alias("text"))
    got = alignment.strip_alignment(markup.nodes(books, "doc_id", "text"), "doc_id")
    return got.select("doc_id", "sid", F.col("group").cast("long").alias("group_no"), "role", "word", F.col("occurrence").cast("long").alias("occurrence"), "strong")


def alignment_rebuilt(spark, sf_dir):
    """Milestones put around the words of two groups a verse: its first two words, and its fourth."""
    docs, words = _aligned(spark, sf_dir)
    tokens = words.select("doc_id", "idx", "surface")
    slot = alignment.numbered(tokens, ["doc_id"], "surface", "idx").select("doc_id", "idx", F.col("norm").alias("word"), F.col("slot").alias("occurrence"))
    targets = slot.where("idx IN (0, 1, 3)").select("doc_id", F.when(F.col("idx") < 2, 0).otherwise(1).alias("group"), F.when(F.col("idx") < 2, 'x-strong="G1"').otherwise('x-strong="G2"').alias("milestone"), "word", "occurrence")
    return alignment.emit_alignment(tokens, targets, ["doc_id"], "idx", "surface")


def formatted_usfm(spark, sf_dir):
    """Documents as tagged text in house style with verses in running text."""
    books = markup.encode_documents(table(spark, sf_dir, "documents"), "doc_id", "text")
    rows = markup.typed(markup.tokens(books, "doc_id", "text"), "doc_id")
    return markup.format_usfm(rows, "doc_id", verse_on_new_line=False).select("doc_id", F.md5("text").alias("text"))


def usj_tree(spark, sf_dir):
    """Documents as nested JSON: verses and text taken out of the tree again."""
    books = markup.encode_documents(table(spark, sf_dir, "documents"), "doc_id", "text")
    trees = markup.to_usj(markup.nodes(books, "doc_id", "text"), "doc_id")
    para = F.from_json(F.get_json_object("usj", "$.content[2].content"), "array<string>")
    verse = F.filter(para, lambda x: F.startswith(x, F.lit('{"type":"verse"')))
    return trees.select("doc_id", F.get_json_object("usj", "$.type").alias("type"), F.get_json_object("usj", "$.content[1].number").alias("chapter"), F.coalesce(F.size(verse), F.lit(0)).cast("long").alias("verses"))


def usj_errors(spark, sf_dir):
    """What is wrong with JSON trees made from parts."""
    p = table(spark, sf_dir, "part")
    root = lambda inner: '{"type":"USJ","version":"3.1","content":' + inner + "}"
    bad = ("{bad", '{"type":"X","version":"3.1","content":[]}', '{"type":"USJ","content":[]}', root("{}"), root('["a",{"type":"p","content":["b",{"type":""}]},null]'), root('[["x"],{"type":"p","content":7},3,true]'), root('["a"]'))
    usj = F.get(F.array(*[F.lit(x) for x in bad]), (F.col("p_partkey") % len(bad)).cast("int"))
    return p.select("p_partkey", F.explode(similarity.usj_errors(usj)).alias("error"))


def html_render(spark, sf_dir):
    books = markup.encode_documents(table(spark, sf_dir, "documents"), "doc_id", "text")
    html = markup.render_xml(markup.nodes(books, "doc_id", "text"), "doc_id", html=True)
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return html.select("doc_id", count("<p ").alias("starts"), count("</p>").alias("ends"), count('<span class="v">').alias("verses"))


def marker_parts(spark, sf_dir):
    """Which part of a preamble each built-in marker belongs to, for as many parts as use it."""
    p = table(spark, sf_dir, "part")
    marker = F.get(F.array(*[F.lit(x) for x in ("id", "mt1", "ip", "p", "toc2", "imt", "h")]), (F.col("p_partkey") % 7).cast("int"))
    return p.select(marker.alias("marker")).groupBy("marker").agg(F.count("*").alias("n")).withColumn("part", markup.preamble_part(F.col("marker")))


def chapters_around(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_regionkey", F.col("n_nationkey").alias("chapter"), F.lit(22).alias("last"))
    got = markup.chapter_context(n, "n_regionkey", "chapter", "last", 1)
    return got.selectExpr("n_regionkey", "CAST(chapter AS BIGINT) AS chapter", "readonly")


def kept_words(spark, sf_dir):
    """How many words of each turn stay in the next turn of its conversation, in order."""
    c = table(spark, sf_dir, "conversations")
    rows = c.select("conv_id", "turn", T.tokenize(F.col("text")).alias("old"), T.tokenize(F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))).alias("new")).where("new IS NOT NULL")
    return alignment.kept_words(rows, "old", "new").select("conv_id", "turn", F.size("kept").cast("long").alias("kept"))


def stream_ingested(spark, sf_dir):
    """Users' events as a stream in which each id counts once."""
    got = stream.run_once(stream.ingest_once(stream.read_log(spark, sf_dir)), stream.folder(spark, "ingested"))
    return got.select("event_id", "user_id", "event_type")


def stream_numbered(spark, sf_dir):
    got = stream.run_once(stream.number_entries(stream.read_log(spark, sf_dir)), stream.folder(spark, "numbered"))
    return got.groupBy("user_id").agg(F.max("sequence").alias("entries"), F.count_distinct("sequence").alias("distinct_numbers"))


QUERIES = {
    f.__name__: f
    for f in (
        help_table, journal_lines, alignment_lines, alignment_sections, usx_import, alignment_groups, alignment_rebuilt, formatted_usfm, usj_tree, usj_errors, html_render, marker_parts, chapters_around,
        kept_words, stream_ingested, stream_numbered,
    )
}

LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
_WORDS = r"""w AS (SELECT item_id AS doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS a FROM benchmark),
t AS (SELECT doc_id, unnest(a) AS s, unnest(range(len(a))) AS idx FROM w),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, s ORDER BY idx) AS occ FROM t)"""

ORACLE_SQL = {
    "help_table": """
SELECT p_brand, CAST(p_partkey AS VARCHAR) AS id, CAST(p_size % 5 AS BIGINT) AS chapter, p_partkey AS verse, CAST(CASE WHEN p_size % 3 = 0 THEN 1 ELSE greatest(p_size % 4, 1) END AS BIGINT) AS occurrence,
  'ta' AS link_type, 'translate/' || replace(lower(p_type), ' ', '-') AS link_id, p_name AS quote FROM part WHERE p_size % 5 > 0 AND p_partkey > 0""",
    "journal_lines": "SELECT user_id, CAST(event_id AS VARCHAR) AS id, event_id AS sequence, event_type AS layer FROM events",
    "alignment_lines": """
SELECT 'TIT ' || l_linenumber || ':' || l_orderkey AS sid, l_linestatus AS second_source, 'w' || l_partkey AS target, CAST(l_linenumber AS BIGINT) AS occurrence,
  concat_ws(chr(9), 'TIT', l_linenumber, l_orderkey, l_returnflag || '+' || l_linestatus, '1/1+1/2', 'G1+G2', 'w' || l_partkey, l_linenumber || '/7', 'l', 'm') AS line FROM lineitem""",
    "alignment_sections": "SELECT n_name AS sid, replace(r_name, ' ', '|') AS sources, n_name || '|x' AS targets FROM nation JOIN region ON n_regionkey = r_regionkey",
    "usx_import": rf"""
WITH l AS (SELECT doc_id, {LINES} AS a FROM documents), v AS (SELECT doc_id, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS n FROM l)
SELECT doc_id, 'D' || doc_id || ' 1:' || n AS sid, md5(trim(regexp_replace(line, '\s+', ' ', 'g'))) AS text FROM v""",
    "alignment_groups": f"""
WITH {_WORDS}
SELECT doc_id, 'B' || doc_id || ' 1:1' AS sid, CAST(idx // 3 AS BIGINT) AS group_no, 'source' AS role, 'c' AS word, 1::BIGINT AS occurrence, 'G' || idx AS strong FROM o WHERE idx % 3 = 0
UNION ALL SELECT doc_id, 'B' || doc_id || ' 1:1', CAST(idx // 3 AS BIGINT), 'target', s, occ, NULL FROM o WHERE idx % 3 = 0""",
    "alignment_rebuilt": f"""
WITH {_WORDS}
SELECT doc_id, string_agg(CASE idx WHEN 0 THEN '\\zaln-s |x-strong="G1"\\*\\w ' || s || '\\w*' WHEN 1 THEN '\\w ' || s || '\\w*\\zaln-e\\*'
  WHEN 3 THEN '\\zaln-s |x-strong="G2"\\*\\w ' || s || '\\w*\\zaln-e\\*' ELSE s END, ' ' ORDER BY idx) AS text, true AS rebuilt FROM t GROUP BY doc_id""",
    "formatted_usfm": rf"""
WITH l AS (SELECT doc_id, {LINES} AS a FROM documents)
SELECT doc_id, md5('\id D' || doc_id || chr(10) || '\c 1' || chr(10) || '\p' || array_to_string(list_transform(range(1, len(a) + 1), lambda i: ' \v ' || i || ' ' || regexp_replace(a[i], '\s+', ' ', 'g')), '')) AS text FROM l""",
    "usj_tree": f"SELECT doc_id, 'USJ' AS type, '1' AS chapter, CAST(len({LINES}) AS BIGINT) AS verses FROM documents",
    "usj_errors": """
SELECT p_partkey, unnest(CASE p_partkey % 7 WHEN 0 THEN ['no JSON object'] WHEN 1 THEN ['$.type: not "USJ"'] WHEN 2 THEN ['$.version: no string'] WHEN 3 THEN ['$.content: no list']
  WHEN 4 THEN ['$.content[1].content[1].type: no name', '$.content[2]: null']
  WHEN 5 THEN ['$.content[0]: a list in a list', '$.content[1].content: neither list nor text'] ELSE [] END) AS error FROM part""",
    "html_render": f"SELECT doc_id, 2::BIGINT AS starts, 2::BIGINT AS ends, CAST(len({LINES}) AS BIGINT) AS verses FROM documents",
    "marker_parts": """
WITH m AS (SELECT ['id', 'mt1', 'ip', 'p', 'toc2', 'imt', 'h'][CAST(p_partkey % 7 AS INT) + 1] AS marker FROM part)
SELECT marker, count(*) AS n, CASE WHEN marker IN ('id', 'toc2', 'h') THEN 'identification' WHEN marker IN ('mt1', 'imt') THEN 'title' WHEN marker = 'ip' THEN 'introduction' ELSE 'other' END AS part FROM m GROUP BY marker""",
    "chapters_around": """
WITH s AS (SELECT n_regionkey, n_nationkey AS c FROM nation WHERE n_nationkey BETWEEN 1 AND 22),
w AS (SELECT DISTINCT n_regionkey, CAST(c + o AS BIGINT) AS chapter FROM s, (SELECT unnest([-1, 0, 1]) AS o) WHERE c + o BETWEEN 1 AND 22)
SELECT w.n_regionkey, w.chapter, s.c IS NULL AS readonly FROM w LEFT JOIN s ON s.n_regionkey = w.n_regionkey AND s.c = w.chapter""",
    "stream_ingested": "SELECT event_id, user_id, event_type FROM events",
    "stream_numbered": "SELECT user_id, count(*) AS entries, count(*) AS distinct_numbers FROM events GROUP BY user_id",
}
