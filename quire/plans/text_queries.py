"""Queries over words and characters of documents."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import helps, similarity
from quire.operators.tokens import token_table, with_occurrence
from quire.operators.windows import joined_runs
from quire.sources.tables import table

LONG = "CAST({0} AS BIGINT) AS {0}"


def token_occurrence(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return with_occurrence(token_table(docs, "doc_id", "text"), "doc_id").selectExpr("doc_id", LONG.format("idx"), "surface", "occurrence", "occurrences")


def edge_punct_norm(spark, sf_dir):
    words = token_table(table(spark, sf_dir, "documents"), "doc_id", "text").select("surface").distinct()
    return words.select("surface", T.strip_edges(F.col("surface")).alias("norm"))


def nth_substring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.nth_place(F.col("text"), F.lit("th"), 3).alias("third_th"), T.nth_place(F.col("text"), F.lit("e"), 5).alias("fifth_e"))


def char_similarity(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    after = F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))
    rows = c.select("conv_id", "turn", "text", after.alias("after")).where("after IS NOT NULL")
    return rows.select("conv_id", "turn", F.round(T.positional_similarity(F.col("text"), F.col("after")), 6).alias("similarity"))


def text_reference_status(spark, sf_dir):
    """A place quoted from each document, of every third document the whole text, looked for in a changed one; every fifth is quoted
    over two verses."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 4
    now = F.when(k == 1, F.concat(F.lit("New. "), "text")).when(k == 2, F.concat(F.substr("text", F.lit(1), F.lit(12)), F.lit("#"), F.substr("text", F.lit(14)))).when(k == 3, F.reverse("text")).otherwise(F.col("text"))
    whole = F.col("doc_id") % 3 == 0
    quote = F.when(whole, F.col("text")).otherwise(F.substr("text", F.lit(6), F.lit(20)))
    rows = d.select("doc_id", now.alias("now"), F.col("text").alias("was"), quote.alias("quote"), F.when(whole, 0).otherwise(5).alias("from"), F.when(whole, F.length("text")).otherwise(25).alias("to"))
    one, two = F.array("now"), F.array(F.lit("x"), F.col("now"))
    current = F.when(F.col("doc_id") % 5 == 0, two).otherwise(one)
    snapshots = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("x"), F.col("was"))).otherwise(F.array("was"))
    r = similarity.resolve_reference(snapshots, current, F.col("quote"), F.col("from"), F.col("to"))
    rows = rows.select("doc_id", r.alias("r"))
    return rows.select("doc_id", "r.status", F.col("r.start").cast("long").alias("begins"), F.col("r.end").cast("long").alias("ends"))


def quote_match_tokens(spark, sf_dir):
    """Each benchmark item's first three words as a quote, placed in its own text shared with documents by their first word."""
    tokens = token_table(table(spark, sf_dir, "benchmark"), "item_id", "text")
    spans = helps.token_spans(tokens, ["item_id"], "idx", "surface")
    joined = tokens.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "surface"))), lambda x: x["surface"]), " ").alias("joined"), F.max(F.when(F.col("idx") == 4, F.col("surface"))).alias("a"), F.max(F.when(F.col("idx") == 5, F.col("surface"))).alias("b"))
    quote = joined.withColumn("quote", F.concat_ws(" ", "a", "b")).withColumn("q_start", F.instr("joined", F.col("quote")) - 1)
    quote = quote.select("item_id", "quote", "q_start", (F.col("q_start") + F.length("quote")).alias("q_end"))
    return helps.match_quotes(quote, spans, ["item_id"], "idx").selectExpr("item_id", "quote", LONG.format("idx"), "surface")


def joined_spans(spark, sf_dir):
    tokens = token_table(table(spark, sf_dir, "documents"), "doc_id", "text")
    return helps.token_spans(tokens, ["doc_id"], "idx", "surface").selectExpr("doc_id", LONG.format("idx"), LONG.format("start"), "CAST(`end` AS BIGINT) AS finish")


def joined_phrases(spark, sf_dir):
    tokens = token_table(table(spark, sf_dir, "benchmark"), "item_id", "text").where(F.length("surface") > 3)
    return joined_runs(tokens, ["item_id"], "idx", "surface")


def collapsed_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(T.collapse(F.col("text"))).alias("both"), F.md5(T.normalize_spaces(F.col("text"), "normalize")).alias("normal"), F.md5(T.normalize_spaces(F.col("text"), "trim-edges")).alias("trimmed"))


def escaped_text(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.md5(T.escape_xml(F.col("html"))).alias("xml"), F.md5(T.escape_tsv(F.col("html"))).alias("tsv"))


def content_hashes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.git_blob_id(F.col("text")).alias("git"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.base64(F.encode("source", "UTF-8")).alias("source64"), T.hash31(F.col("source")).alias("short_hash"), T.base36(T.hash31(F.col("source"))).alias("base36"), T.from_base64(F.base64(F.encode("lang", "UTF-8"))).alias("lang"))


def fragments_joined(spark, sf_dir):
    d = table(spark, sf_dir, "benchmark")
    return d.select("item_id", F.md5(T.join_fragments(F.split("text", " "))).alias("joined"))


def slugs(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", T.repo_name(F.col("p_brand"), F.concat_ws("._ ", "p_name", "p_type")).alias("slug"), T.title_from_path(F.concat(F.lit("/bible/kt/"), F.replace(F.lower("p_type"), F.lit(" "), F.lit("-")), F.lit(".md"))).alias("title"))


def sync_names(spark, sf_dir):
    """Branches of suppliers for parts' brands, and how long after so many failures they are tried again."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").cast("int").alias("n"))
    book = F.concat(F.lit(" B"), F.col("n").cast("string"), F.lit("/Ü "))
    return s.select("s_suppkey", T.branch_name(book, F.col("s_name")).alias("own"), T.branch_name(book).alias("shared"), T.retry_delay(F.col("n") % 8).alias("delay"), T.download_wait(F.col("n") % 8).alias("wait"))


QUERIES = {f.__name__: f for f in (token_occurrence, edge_punct_norm, nth_substring, char_similarity, text_reference_status, quote_match_tokens, joined_spans, joined_phrases, collapsed_text, escaped_text, content_hashes, fragments_joined, slugs, sync_names)}

WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> '')"

ORACLE_SQL = {
    "token_occurrence": rf"""
WITH w AS (SELECT doc_id, {WORDS.format("text")} AS a FROM documents),
t AS (SELECT doc_id, unnest(a) AS surface, unnest(range(len(a))) AS idx FROM w)
SELECT doc_id, CAST(idx AS BIGINT) AS idx, surface,
       row_number() OVER (PARTITION BY doc_id, surface ORDER BY idx) AS occurrence,
       count(*) OVER (PARTITION BY doc_id, surface) AS occurrences
FROM t""",
    "edge_punct_norm": rf"""
WITH t AS (SELECT DISTINCT unnest({WORDS.format("text")}) AS surface FROM documents)
SELECT surface, regexp_replace(surface, '^[^\p{{L}}\p{{N}}''’]+|[^\p{{L}}\p{{N}}''’]+$', '', 'g') AS norm FROM t""",
    "nth_substring": """
WITH s AS (SELECT doc_id, string_split(text, 'th') AS a, string_split(text, 'e') AS b FROM documents)
SELECT doc_id, CAST(CASE WHEN len(a) > 3 THEN length(array_to_string(a[1:3], 'th')) ELSE -1 END AS BIGINT) AS third_th,
  CAST(CASE WHEN len(b) > 5 THEN length(array_to_string(b[1:5], 'e')) ELSE -1 END AS BIGINT) AS fifth_e FROM s""",
    "char_similarity": """
WITH p AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations)
SELECT conv_id, turn, round(CASE WHEN greatest(length(text), length(after)) = 0 THEN 1.0::DOUBLE ELSE
  len(list_filter(range(1, least(length(text), length(after)) + 1), lambda i: substr(text, i, 1) = substr(after, i, 1)))::DOUBLE / greatest(length(text), length(after)) END, 6) AS similarity
FROM p WHERE after IS NOT NULL""",
    "text_reference_status": """
WITH r AS (SELECT doc_id, text, doc_id % 3 = 0 AS whole, CASE WHEN doc_id % 3 = 0 THEN text ELSE substr(text, 6, 20) END AS quote, doc_id % 5 = 0 AS two,
  CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 5 END AS f, CASE WHEN doc_id % 3 = 0 THEN length(text) ELSE 25 END AS t,
  CASE doc_id % 4 WHEN 1 THEN 'New. ' || text WHEN 2 THEN substr(text, 1, 12) || '#' || substr(text, 14) WHEN 3 THEN reverse(text) ELSE text END AS v FROM documents),
h AS (SELECT *, CASE WHEN two THEN 'x ' || v ELSE v END AS now, CASE WHEN two THEN 'x ' || text ELSE quote END AS old FROM r),
c AS (SELECT *, string_split(old, '') AS a, string_split(now, '') AS b FROM h),
k AS (SELECT *, instr(now, quote) - 1 AS k0, CASE WHEN two THEN f = 0 AND t = length(v) AND starts_with(now, quote) ELSE substr(now, f + 1, t - f) = quote END AS here,
  CASE WHEN greatest(len(a), len(b)) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i]))::DOUBLE / greatest(len(a), len(b)) END AS sim FROM c),
z AS (SELECT *, CASE WHEN here AND (NOT two OR k0 >= 0) THEN 'exact' WHEN k0 >= 0 THEN 'relocated' WHEN sim >= 0.7 THEN 'approximate' ELSE 'stale' END AS status FROM k)
SELECT doc_id, status, CAST(CASE status WHEN 'exact' THEN CASE WHEN two THEN k0 ELSE f END WHEN 'relocated' THEN k0 WHEN 'approximate' THEN 0 END AS BIGINT) AS begins,
  CAST(CASE status WHEN 'exact' THEN CASE WHEN two THEN k0 + length(quote) ELSE t END WHEN 'relocated' THEN k0 + length(quote) WHEN 'approximate' THEN least(length(now), length(quote)) END AS BIGINT) AS ends FROM z""",
    "quote_match_tokens": rf"""
WITH w AS (SELECT item_id, {WORDS.format("text")} AS a FROM benchmark),
q AS (SELECT item_id, a, array_to_string(a, ' ') AS joined, a[5] || ' ' || a[6] AS quote FROM w),
s AS (SELECT item_id, quote, instr(joined, quote) - 1 AS q_start, instr(joined, quote) - 1 + length(quote) AS q_end, unnest(a) AS surface, unnest(range(len(a))) AS idx FROM q),
e AS (SELECT *, sum(length(surface) + 1) OVER (PARTITION BY item_id ORDER BY idx) - 1 AS fin FROM s)
SELECT item_id, quote, CAST(idx AS BIGINT) AS idx, surface FROM e WHERE fin > q_start AND fin - length(surface) < q_end""",
    "joined_spans": rf"""
WITH w AS (SELECT doc_id, {WORDS.format("text")} AS a FROM documents),
t AS (SELECT doc_id, unnest(a) AS s, unnest(range(len(a))) AS idx FROM w),
e AS (SELECT *, sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS fin FROM t)
SELECT doc_id, CAST(idx AS BIGINT) AS idx, CAST(fin - length(s) AS BIGINT) AS start, CAST(fin AS BIGINT) AS finish FROM e""",
    "joined_phrases": rf"""
WITH w AS (SELECT item_id, {WORDS.format("text")} AS a FROM benchmark),
t AS (SELECT item_id, unnest(a) AS s, unnest(range(len(a))) AS idx FROM w),
k AS (SELECT *, lag(idx) OVER (PARTITION BY item_id ORDER BY idx) AS b FROM t WHERE length(s) > 3)
SELECT item_id, string_agg(CASE WHEN b IS NULL THEN '' WHEN idx - b = 1 THEN ' ' ELSE ' … ' END || s, '' ORDER BY idx) AS phrase FROM k GROUP BY item_id""",
    "collapsed_text": r"""
SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS "both", md5(regexp_replace(text, '\s+', ' ', 'g')) AS normal,
  md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS trimmed FROM documents""",
    "escaped_text": """
SELECT page_id,
  md5(replace(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;'), chr(160), '&#160;')) AS xml,
  md5(CASE WHEN regexp_matches(html, '[\\t"\\n\\r]') THEN '"' || replace(html, '"', '""') || '"' ELSE html END) AS tsv FROM pages""",
    "content_hashes": """
SELECT doc_id, sha1(encode('blob ' || strlen(text)) || '\\x00'::BLOB || encode(text)) AS git, sha256(text) AS sha256, base64(encode(source)) AS source64,
  CAST(list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length(source) + 1), lambda i: unicode(substr(source, i, 1))::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) AS BIGINT) AS short_hash,
  lower(to_base(list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length(source) + 1), lambda i: unicode(substr(source, i, 1))::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296), 36)) AS base36, lang FROM documents""",
    "fragments_joined": r"""
WITH d AS (SELECT item_id, list_prepend('', string_split(text, ' ')) AS w FROM benchmark)
SELECT item_id, md5(list_reduce(w, lambda s, x: s || CASE WHEN s = '' OR x = '' THEN '' WHEN regexp_matches(right(s, 1), '[\p{L}\p{N}\p{M}]') AND regexp_matches(left(x, 1), '[\p{L}\p{N}\p{M}(\[{"''«„]') THEN ' '
  WHEN regexp_matches(right(s, 1), '[)\]}"''»]') AND regexp_matches(left(x, 1), '[\p{L}\p{N}\p{M}]') THEN ' ' WHEN regexp_matches(right(s, 1), '[.!?:;,]') AND regexp_matches(left(x, 1), '\p{L}') THEN ' ' ELSE '' END || x)) AS joined FROM d""",
    "slugs": r"""
SELECT p_partkey, regexp_replace(regexp_replace(lower(p_brand), '[^a-z0-9.-]', '-', 'g') || '_' || regexp_replace(lower(p_name || '._ ' || p_type), '[^a-z0-9._-]', '-', 'g'), '-+', '-', 'g') AS slug,
  array_to_string(list_transform(string_split(replace(lower(p_type), ' ', '-'), '-'), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS title FROM part""",
    "sync_names": """
SELECT s_suppkey, regexp_replace(lower(s_name), '[^a-z0-9._-]', '-', 'g') || '/b' || s_nationkey || '--' AS own, 'b' || s_nationkey || '--' AS shared,
  CAST([30000, 120000, 600000, 1800000, 7200000][least(s_nationkey % 8, 4) + 1] AS BIGINT) AS delay, CAST(least(2000 * pow(2, s_nationkey % 8), 60000) AS BIGINT) AS wait FROM supplier""",
}
