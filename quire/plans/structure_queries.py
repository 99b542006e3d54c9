"""Queries over markup, histograms and similarity."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import markers
from quire.functions import text as T
from quire.operators import markup, similarity
from quire.operators.tokens import token_table, with_occurrence
from quire.sources.tables import table


def bigram_dice_pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    after = F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))
    pairs = c.select("conv_id", "turn", "text", after.alias("after")).where("after IS NOT NULL")
    return pairs.select("conv_id", "turn", F.round(similarity.dice("text", "after"), 6).alias("dice"))


def type_histogram(spark, sf_dir):
    return similarity.histogram(table(spark, sf_dir, "events"), ["user_id"], "event_type")


def histogram_cosine(spark, sf_dir):
    h = similarity.histogram(table(spark, sf_dir, "events"), ["user_id"], "event_type")
    after = h.select((F.col("user_id") - 1).alias("user_id"), "event_type", "n")
    return similarity.histogram_cosine(h, after, ["user_id"], "event_type", "inner").select("user_id", F.round("cosine", 6).alias("cosine"))


def strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


def tag_counts(spark, sf_dir):
    tags = table(spark, sf_dir, "pages").select("page_id", F.explode(T.tag_names(F.col("html"))).alias("tag"))
    return tags.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


def attribute_agreement(spark, sf_dir):
    """Agreement of the attributes of each part with those of the part of the next key."""
    p = table(spark, sf_dir, "part")
    attrs = F.create_map(F.lit("brand"), "p_brand", F.lit("type"), "p_type", F.lit("size"), F.col("p_size").cast("string"))
    a = p.select("p_partkey", attrs.alias("a"))
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), attrs.alias("b"))
    return a.join(b, "p_partkey").select("p_partkey", F.round(similarity.shared_attributes(F.col("a"), F.col("b")), 6).alias("agreement"))


def _books(spark, sf_dir):
    return markup.encode_documents(table(spark, sf_dir, "documents"), "doc_id", "text")


def parse_verses(spark, sf_dir):
    node = markup.nodes(_books(spark, sf_dir), "doc_id", "text")
    return markup.verse_texts(node, "doc_id").select("doc_id", "chapter", "verse", "sid", "text")


def chapter_slices(spark, sf_dir):
    node = markup.nodes(_books(spark, sf_dir), "doc_id", "text")
    return markup.chapters(node, "doc_id").select("doc_id", "book", "chapter", "n_verses")


def parse_attributes(spark, sf_dir):
    docs = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id")
    words = with_occurrence(token_table(docs, "doc_id", "text"), "doc_id")
    node = markup.nodes(markup.encode_words(docs, "doc_id", words), "doc_id", "text")
    rows = markup.word_attributes(node, "doc_id").groupBy("doc_id", "sid", "pos", "surface").pivot("attribute", ["x-occurrence", "x-occurrences"]).agg(F.first("value"))
    idx = F.row_number().over(W.partitionBy("doc_id").orderBy("pos")) - 1
    return rows.select("doc_id", "sid", idx.cast("long").alias("idx"), "surface", F.col("x-occurrence").cast("long").alias("occurrence"), F.col("x-occurrences").cast("long").alias("occurrences"))


def render_roundtrip(spark, sf_dir):
    books = _books(spark, sf_dir)
    again = markup.render_usfm(markup.tokens(books, "doc_id", "text"), "doc_id")
    both = books.join(again.withColumnRenamed("text", "again"), "doc_id")
    return both.select("doc_id", (F.col("text") == F.col("again")).alias("equal"))


def render_usx(spark, sf_dir):
    """Verses of the XML form: how often each tag opens, and whether every verse start has its end."""
    xml = markup.render_xml(markup.nodes(_books(spark, sf_dir), "doc_id", "text"), "doc_id")
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return xml.select("doc_id", count("<para ").alias("paras"), count("</para>").alias("para_ends"), count('<verse number="').alias("starts"), count('<verse eid="').alias("ends"))


def marker_lookup(spark, sf_dir):
    """Marker names made from part sizes, each at the start of a line of a book of its own and once in running text, as typed."""
    p = table(spark, sf_dir, "part")
    name = F.concat(F.get(F.array(*[F.lit(x) for x in ("q", "tc", "mt", "zz", "s")]), (F.col("p_partkey") % 5).cast("int")), F.col("p_size").cast("string"))
    books = p.select("p_partkey", F.concat(F.lit("\\id B\n\\"), name, F.lit(" text \\"), name, F.lit(" more")).alias("text"))
    rows = markup.typed(markup.tokens(books, "p_partkey", "text"), "p_partkey").where("pos > 0")
    return rows.select("p_partkey", F.col("pos").cast("long").alias("pos"), "marker", "kind", (F.col("style") == "unknown").alias("inferred"), markers.cell_span(F.col("marker")).cast("long").alias("span"), markers.cell_align(F.col("marker")).alias("align"))


QUERIES = {f.__name__: f for f in (bigram_dice_pairs, type_histogram, histogram_cosine, strip_tags, tag_counts, attribute_agreement, parse_verses, chapter_slices, parse_attributes, render_roundtrip, render_usx, marker_lookup)}

LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"

ORACLE_SQL = {
    "bigram_dice_pairs": """
WITH p AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations),
q AS (SELECT * FROM p WHERE after IS NOT NULL),
a AS (SELECT conv_id, turn, g, count(*) AS n FROM (SELECT conv_id, turn, unnest(list_transform(range(1, length(text)), lambda i: substr(text, i, 2))) AS g FROM q) GROUP BY ALL),
b AS (SELECT conv_id, turn, g, count(*) AS n FROM (SELECT conv_id, turn, unnest(list_transform(range(1, length(after)), lambda i: substr(after, i, 2))) AS g FROM q) GROUP BY ALL),
s AS (SELECT conv_id, turn, sum(least(a.n, b.n)) AS k FROM a JOIN b USING (conv_id, turn, g) GROUP BY ALL)
SELECT conv_id, turn, round(CASE WHEN length(text) < 2 AND length(after) < 2 THEN CAST(text = after AS DOUBLE)
  ELSE 2 * coalesce(k, 0)::DOUBLE / (greatest(length(text) - 1, 0) + greatest(length(after) - 1, 0)) END, 6) AS dice
FROM q LEFT JOIN s USING (conv_id, turn)""",
    "type_histogram": "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL",
    "histogram_cosine": """
WITH h AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
m AS (SELECT user_id, sqrt(CAST(sum(n * n) AS DOUBLE)) AS norm FROM h GROUP BY ALL),
d AS (SELECT a.user_id, sum(a.n * b.n) AS k FROM h a JOIN h b ON b.user_id = a.user_id + 1 AND a.event_type = b.event_type GROUP BY ALL)
SELECT a.user_id, round(coalesce(k, 0)::DOUBLE / (a.norm * b.norm), 6) AS cosine
FROM m a JOIN m b ON b.user_id = a.user_id + 1 LEFT JOIN d ON d.user_id = a.user_id""",
    "strip_tags": "SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS text FROM pages",
    "tag_counts": r"SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([A-Za-z][\w:.-]*)', 1)) AS tag FROM pages) GROUP BY ALL",
    "attribute_agreement": """
SELECT a.p_partkey, round((CAST(a.p_brand = b.p_brand AS INT) + CAST(a.p_type = b.p_type AS INT) + CAST(a.p_size = b.p_size AS INT)) / 3.0::DOUBLE, 6) AS agreement
FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""",
    "parse_verses": rf"""
WITH l AS (SELECT doc_id, {LINES} AS a FROM documents),
v AS (SELECT doc_id, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS n FROM l)
SELECT doc_id, '1' AS chapter, CAST(n AS VARCHAR) AS verse, 'D' || doc_id || ' 1:' || n AS sid, trim(regexp_replace(line, '\s+', ' ', 'g')) AS text FROM v""",
    "chapter_slices": rf"""
WITH l AS (SELECT doc_id, len({LINES}) AS n FROM documents)
SELECT doc_id, 'D' || doc_id AS book, c AS chapter, CASE WHEN c = '1' THEN n ELSE 0 END AS n_verses FROM l, (SELECT unnest(['0', '1']) AS c)""",
    "parse_attributes": r"""
WITH w AS (SELECT item_id AS doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS a FROM benchmark),
t AS (SELECT doc_id, unnest(a) AS surface, unnest(range(len(a))) AS idx FROM w)
SELECT doc_id, 'W' || doc_id || ' 1:1' AS sid, CAST(idx AS BIGINT) AS idx, surface,
  row_number() OVER (PARTITION BY doc_id, surface ORDER BY idx) AS occurrence, count(*) OVER (PARTITION BY doc_id, surface) AS occurrences FROM t""",
    "render_roundtrip": "SELECT doc_id, true AS equal FROM documents",
    "render_usx": rf"""
SELECT doc_id, 2::BIGINT - 0 AS paras, 2::BIGINT AS para_ends, CAST(len({LINES}) AS BIGINT) AS starts, CAST(len({LINES}) AS BIGINT) AS ends FROM documents""",
    "marker_lookup": """
WITH r AS (SELECT p_partkey, p_size, p_partkey % 5 AS k, ['q', 'tc', 'mt', 'zz', 's'][CAST(p_partkey % 5 AS INT) + 1] || p_size AS marker, unnest([1, 2]) AS pos FROM part)
SELECT p_partkey, CAST(pos AS BIGINT) AS pos, marker, CASE WHEN k = 1 OR k = 3 AND pos = 2 THEN 'character' ELSE 'paragraph' END AS kind, k = 3 AS inferred, CASE WHEN k = 1 THEN 1::BIGINT END AS span, 'start' AS align FROM r""",
}
