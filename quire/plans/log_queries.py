"""Queries over event logs, versions, catalogs and checklists."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators import alignment, catalog, checking, helps, journal, versions
from quire.operators.tokens import token_table
from quire.operators.windows import carry, evicted, islands
from quire.sources.tables import table
from quire.streaming import windows as stream


def context_carry(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return carry(c, ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("text")), "context").select("conv_id", "turn", "context")


def event_islands(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return islands(e.withColumn("place", n), ["user_id"], "place", ["event_type"])


def _entries(spark, sf_dir):
    """Events as journal entries, every seventh of them delivered twice."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props", "ts")
    return e.unionByName(e.where("event_id % 7 = 0"))


def journal_dedupe(spark, sf_dir):
    return journal.dedupe(_entries(spark, sf_dir), "event_id", ["ts", "event_id"]).select("event_id", "user_id", "event_type", "value")


def vector_clock(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("doc", F.col("event_type"))
    return journal.vector_clock(e, ["doc"], "user_id", "event_id")


def clock_merge(spark, sf_dir):
    """Clocks of each user over event types from the early and the late half of the log, merged."""
    e = table(spark, sf_dir, "events")
    clock = lambda df, name: df.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "seq"))).alias(name))
    half = lambda odd: e.where(F.col("event_id") % 2 == odd).groupBy("user_id", "event_type").agg(F.max("event_id").alias("seq"))
    both = clock(half(0), "a").join(clock(half(1), "b"), "user_id")
    merged = both.select("user_id", F.explode(journal.merge_clocks(F.col("a"), F.col("b"))).alias("event_type", "sequence"))
    return merged


def compaction_plan(spark, sf_dir):
    return journal.compaction_plan(table(spark, sf_dir, "events"), ["user_id"], F.col("props"))


def entries_after(spark, sf_dir):
    return journal.after(table(spark, sf_dir, "events"), "event_id", 100).select("event_id", "user_id")


def journal_fold(spark, sf_dir):
    return journal.fold(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")


def presence(spark, sf_dir):
    kinds = table(spark, sf_dir, "events")
    return journal.presence(kinds, "user_id", ["ts", "event_id"], "event_type", "click")


def convergence(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", F.md5("lang").alias("digest"))
    return journal.converged(d, ["source"], "digest")


def lru_evict(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    total = d.agg(F.sum(F.length("text") * 2).alias("t")).first()["t"] or 0
    return evicted(d, ["doc_id"], F.length("text") * 2, int(total * 0.9), 0.8).select("doc_id")


def active_entries(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    rows = c.select("conv_id", "turn", "role", F.when(F.col("turn") % 3 == 2, F.col("turn") - 2).alias("supersedes"))
    return checking.active(rows, ["conv_id"], "turn", "supersedes").select("conv_id", "turn", "role")


def latest_per_key(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return catalog.latest_release(o, ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


def updates_available(spark, sf_dir):
    """The newest order of each customer, where it isn't among the shipped ones."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo"), "o_orderdate", F.col("o_orderkey").alias("tag"), "o_orderstatus")
    return catalog.latest_not_cached(o.drop("o_orderstatus"), o.where("o_orderstatus = 'F'").select("repo", "tag"), ["repo"], "o_orderdate", "tag").select("repo", "tag")


def outdated_books(spark, sf_dir):
    pins = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book"), F.col("o_orderstatus").alias("version"))
    now = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("book"), F.when(F.col("c_acctbal") > 0, "O").otherwise("F").alias("version"))
    return catalog.outdated(pins, now, ["book"], "version")


def sources_by_book(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.struct("l_orderkey", "l_linenumber").alias("place"))
    return catalog.sources_by_book(rows, "l_partkey", "place", "l_suppkey")


def queue_peek(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    jobs = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "queued").otherwise("done").alias("status"), F.col("o_orderpriority").alias("priority"), F.struct("o_orderdate", "o_orderkey").alias("created"))
    return catalog.next_job(jobs, "status", "priority", "created").select("o_orderkey", "priority")


def catalog_page(spark, sf_dir):
    return catalog.page(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), ["s_name", "s_suppkey"], 20, 3)


def read_through(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select("c_custkey")
    first = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").cast("string").alias("value"))
    second = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", F.col("c_name").alias("value"))
    return catalog.read_through(keys, [first, second], ["c_custkey"], "value").selectExpr("c_custkey", "value", "CAST(tier AS BIGINT) AS tier")


def language_direction(spark, sf_dir):
    """Languages of documents and some more, with a language table that lists two of them as written from right to left."""
    d = table(spark, sf_dir, "documents").select("lang").distinct()
    more = table(spark, sf_dir, "nation").select(F.get(F.array(*[F.lit(x) for x in ("HBO", "ar-x-a", "ku", " ku-Arab ", "sd", "")]), (F.col("n_nationkey") % 6).cast("int")).alias("lang")).distinct()
    names = table(spark, sf_dir, "region").select(F.when(F.col("r_regionkey") == 0, "SD").when(F.col("r_regionkey") == 1, "de").otherwise("fr").alias("lc"), F.when(F.col("r_regionkey") < 2, "rtl").alias("ld"))
    return catalog.with_direction(d.unionByName(more), "lang", names)


def bundle_verify(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), "doc_id", "text")
    manifest = d.select("path", F.sha2(F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary"), 256).alias("sha256"))
    return catalog.verify_bundle(manifest, d.where("doc_id % 10 <> 4"), "path", "text").select("path")


def three_way_merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    side = lambda gone, changed, name: c.select("c_custkey", F.when(gone, None).when(changed, F.concat("c_name", F.lit(name))).otherwise(F.col("c_name")).alias("content"))
    base, ours = side(k % 11 == 0, F.lit(False), ""), side(k % 7 == 0, k % 3 == 0, "-o")
    theirs = side(k % 13 == 0, k % 5 == 0, "-t")
    return versions.three_way(base, ours, theirs, "c_custkey", "content")


def sha_changes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    digest = F.sha2(F.col("text").cast("binary"), 256)
    local = d.where("doc_id % 9 <> 1").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.sha2(F.concat("text", F.lit(".")).cast("binary"), 256)).otherwise(digest).alias("sha"))
    return versions.changes(local, d.where("doc_id % 8 <> 2").select("doc_id", digest.alias("sha")), "doc_id", "sha")


def _line_versions(spark, sf_dir):
    """Lines of each document, and of a version without the last line of even documents and with one line changed."""
    d = table(spark, sf_dir, "documents")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line")).withColumn("place", F.col("place").cast("long"))
    last = F.max("place").over(W.partitionBy("doc_id"))
    new = lines.withColumn("last", last).where("NOT (doc_id % 2 = 0 AND place = last)")
    new = new.withColumn("line", F.when(F.col("place") == 1, F.concat("line", F.lit(" changed"))).otherwise(F.col("line"))).drop("last")
    more = lines.groupBy("doc_id").agg((F.max("place") + 1).alias("place")).where("doc_id % 3 = 1 AND doc_id % 2 = 1").withColumn("line", F.lit("added"))
    return lines, new.unionByName(more)


def structural_diff(spark, sf_dir):
    old, new = _line_versions(spark, sf_dir)
    ops = versions.diff(old, new, ["doc_id"], "place", "line")
    return ops.select("doc_id", "op", "place", F.md5(F.coalesce("line", F.lit(""))).alias("content"))


def diff_applied(spark, sf_dir):
    old, new = _line_versions(spark, sf_dir)
    made = versions.apply_ops(old, versions.diff(old, new, ["doc_id"], "place", "line"), ["doc_id"], "place", "line")
    return made.select("doc_id", "place", F.md5("line").alias("content"))


def op_overlaps(spark, sf_dir):
    """Operations made from order lines: two suppliers' edits of the same order and line pair."""
    li = table(spark, sf_dir, "lineitem")
    ops = li.select("l_orderkey", F.col("l_linenumber").cast("long").alias("op_id"), F.array((F.col("l_linenumber") % 3).cast("long"), (F.col("l_partkey") % 2)).alias("path"))
    return versions.overlaps(ops.where("op_id % 2 = 0"), ops.where("op_id % 2 = 1"), ["l_orderkey"])


def progress_percent(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = d.groupBy("source").agg(F.count("quality").alias("covered"), F.count("*").alias("total"))
    return rows.withColumn("percent", alignment.progress(F.col("covered"), F.col("total")))


def match_confidence(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = d.groupBy("source").agg(F.sum("quality").alias("matched"), F.count("*").alias("total"))
    return rows.select("source", F.round(F.col("matched") / F.col("total"), 6).alias("ratio"), alignment.confidence(F.col("matched"), F.col("total")).alias("tier"))


def target_places(spark, sf_dir):
    """The second occurrence of each word of the benchmark, resolved to its place."""
    tokens = token_table(table(spark, sf_dir, "benchmark"), "item_id", "text")
    targets = tokens.select("item_id", F.col("surface").alias("word")).distinct().withColumn("occurrence", F.lit(2))
    return alignment.resolve_targets(targets, tokens, ["item_id"], "surface", "idx").selectExpr("item_id", "word", "CAST(place AS BIGINT) AS place")


def checklist_items(spark, sf_dir):
    books = table(spark, sf_dir, "nation").select(F.col("n_name").alias("book"), (F.col("n_nationkey") % 7).alias("verses"))
    return checking.coverage_items(books, "book", "verses").selectExpr("book", "CAST(verse AS BIGINT) AS verse", "id", "status")


def checklist_updates(spark, sf_dir):
    books = table(spark, sf_dir, "nation").select(F.col("n_name").alias("book"), (F.col("n_nationkey") % 7).alias("verses"))
    items = checking.coverage_items(books, "book", "verses").select("id", "status")
    more = table(spark, sf_dir, "region").select(F.concat(F.col("r_name"), F.lit(":1")).alias("id"), F.lit("pending").alias("status"))
    patch = items.where(F.endswith("id", F.lit(":2"))).select("id", F.lit("done").alias("status"))
    return checking.update_status(checking.merge_items(items, more, "id"), patch, "id")


def upsert_threads(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return checking.upsert(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("new")), ["o_orderkey"])


def json_field(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def help_references(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem")
    ref = F.concat(F.when(F.col("l_linenumber") == 7, "Front").otherwise((F.col("l_partkey") % 4).cast("string")), F.lit(":"), F.when(F.col("l_quantity") > 45, "INTRO").otherwise((F.col("l_suppkey") % 5).cast("string")))
    rows = o.select("l_orderkey", "l_linenumber", helps.parse_reference(ref).alias("r"))
    return rows.selectExpr("l_orderkey", "CAST(l_linenumber AS BIGINT) AS l_linenumber", "r.kind AS kind", "CAST(r.chapter AS BIGINT) AS chapter", "CAST(r.verse AS BIGINT) AS verse")


def rc_links(spark, sf_dir):
    """Links made from parts, found in a text and taken apart."""
    p = table(spark, sf_dir, "part")
    text = F.concat(F.lit("See [[rc://en/tw/dict/bible/kt/"), F.replace(F.lower("p_type"), F.lit(" "), F.lit("-")), F.lit("]] and (rc://*/ta/man/translate/x"), F.col("p_partkey").cast("string"), F.lit(")."))
    link = p.select("p_partkey", F.explode(helps.rc_links(text)).alias("link"))
    return link.select("p_partkey", "link", helps.parse_rc(F.col("link")).alias("r")).select("p_partkey", "link", "r.language", "r.resource", "r.type", "r.entry", "r.title")


def window_stream_counts(spark, sf_dir):
    return stream.window_counts_once(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        context_carry, event_islands, journal_dedupe, vector_clock, clock_merge, compaction_plan, entries_after, journal_fold, presence, convergence, lru_evict, active_entries, latest_per_key, updates_available,
        outdated_books, sources_by_book, queue_peek, catalog_page, read_through, language_direction, bundle_verify, three_way_merge, sha_changes, structural_diff, diff_applied, op_overlaps, progress_percent,
        match_confidence, target_places, checklist_items, checklist_updates, upsert_threads, json_field, help_references, rc_links, window_stream_counts,
    )
}

_NEW_LINES = """
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place, len(string_split(text, chr(10))) AS n FROM documents),
nw AS (SELECT doc_id, place, CASE WHEN place = 1 THEN line || ' changed' ELSE line END AS line FROM l WHERE NOT (doc_id % 2 = 0 AND place = n - 1)
      UNION ALL SELECT DISTINCT doc_id, n, 'added' FROM l WHERE doc_id % 3 = 1 AND doc_id % 2 = 1)"""

ORACLE_SQL = {
    "context_carry": "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS context FROM conversations",
    "event_islands": """
WITH p AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events),
r AS (SELECT *, place - row_number() OVER (PARTITION BY user_id, event_type ORDER BY place) AS run FROM p)
SELECT user_id, event_type, min(place) AS first, count(*) AS length FROM r GROUP BY user_id, event_type, run""",
    "journal_dedupe": "SELECT event_id, user_id, event_type, value FROM events",
    "vector_clock": "SELECT event_type AS doc, user_id, max(event_id) AS event_id FROM events GROUP BY ALL",
    "clock_merge": """
SELECT user_id, event_type, max(event_id) AS sequence FROM events
WHERE user_id IN (SELECT user_id FROM events WHERE event_id % 2 = 0) AND user_id IN (SELECT user_id FROM events WHERE event_id % 2 = 1) GROUP BY ALL""",
    "compaction_plan": "SELECT user_id, count(*) AS entries, CAST(sum(length(props)) AS BIGINT) AS bytes, count(*) > 200 OR sum(length(props)) > 1048576 AS compact FROM events GROUP BY ALL",
    "entries_after": "SELECT event_id, user_id FROM events WHERE event_id > 100",
    "journal_fold": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS n FROM events GROUP BY ALL",
    "presence": "SELECT * FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id) WHERE event_type <> 'click'",
    "convergence": "SELECT source, count(DISTINCT lang) = 1 AS same FROM documents GROUP BY source",
    "lru_evict": """
WITH s AS (SELECT doc_id, length(text) * 2 AS n, sum(length(text) * 2) OVER (ORDER BY doc_id) AS upto, sum(length(text) * 2) OVER () AS total FROM documents)
SELECT doc_id FROM s WHERE total > floor(total * 0.9) AND total - (upto - n) > 0.8 * floor(total * 0.9)""",
    "active_entries": """
SELECT conv_id, turn, role FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn % 3 = 2 AND d.turn - 2 = c.turn)""",
    "latest_per_key": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS k FROM orders) WHERE k = 1",
    "updates_available": """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS k FROM orders)
SELECT o_custkey AS repo, o_orderkey AS tag FROM n WHERE k = 1 AND o_orderstatus <> 'F'""",
    "outdated_books": """
SELECT DISTINCT o_custkey AS book, o_orderstatus AS version, CASE WHEN c_acctbal > 0 THEN 'O' ELSE 'F' END AS current_version
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> CASE WHEN c_acctbal > 0 THEN 'O' ELSE 'F' END""",
    "sources_by_book": "SELECT l_partkey, arg_max(l_suppkey, (l_orderkey, l_linenumber)) AS l_suppkey FROM lineitem GROUP BY l_partkey",
    "queue_peek": "SELECT o_orderkey, o_orderpriority AS priority FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 1",
    "catalog_page": "SELECT s_suppkey, s_name FROM supplier ORDER BY s_name, s_suppkey LIMIT 20 OFFSET 40",
    "read_through": """
WITH a AS (SELECT o_custkey, CAST(max(o_orderkey) AS VARCHAR) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT c_custkey, coalesce(v, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name END) AS value, CAST(CASE WHEN v IS NOT NULL THEN 1 WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 0 END AS BIGINT) AS tier
FROM customer LEFT JOIN a ON o_custkey = c_custkey""",
    "language_direction": """
WITH l AS (SELECT DISTINCT lang FROM documents UNION ALL SELECT unnest(['HBO', 'ar-x-a', 'ku', ' ku-Arab ', 'sd', '']))
SELECT lang, CASE WHEN lang IN ('HBO', 'ar-x-a', ' ku-Arab ', 'sd', 'de', 'ar', 'fa', 'he', 'ur') THEN 'rtl' ELSE 'ltr' END AS direction FROM l""",
    "bundle_verify": "SELECT 'd/' || doc_id AS path FROM documents WHERE doc_id % 10 = 3",
    "three_way_merge": """
WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_name END AS b,
  CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN c_name || '-o' ELSE c_name END AS o,
  CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN c_name || '-t' ELSE c_name END AS t FROM customer),
a AS (SELECT *, CASE WHEN o IS NOT DISTINCT FROM t AND o IS NOT DISTINCT FROM b THEN 'same' WHEN o IS NOT DISTINCT FROM t OR t IS NOT DISTINCT FROM b THEN 'ours'
  WHEN o IS NOT DISTINCT FROM b THEN 'theirs' ELSE 'conflict' END AS action FROM s)
SELECT c_custkey, action, CASE WHEN action = 'theirs' THEN t ELSE o END AS content FROM a""",
    "sha_changes": """
SELECT doc_id, CASE WHEN doc_id % 8 = 2 THEN 'new' WHEN doc_id % 9 = 1 THEN 'deleted' ELSE 'changed' END AS change FROM documents
WHERE NOT (doc_id % 8 = 2 AND doc_id % 9 = 1) AND (doc_id % 8 = 2 OR doc_id % 9 = 1 OR doc_id % 5 = 0)""",
    "structural_diff": f"""
WITH {_NEW_LINES}
SELECT coalesce(l.doc_id, nw.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'insertNode' WHEN nw.doc_id IS NULL THEN 'removeNode' ELSE 'setText' END AS op,
  coalesce(l.place, nw.place) AS place, md5(coalesce(nw.line, '')) AS content
FROM l FULL JOIN nw ON l.doc_id = nw.doc_id AND l.place = nw.place WHERE l.line IS DISTINCT FROM nw.line""",
    "diff_applied": f"WITH {_NEW_LINES} SELECT doc_id, place, md5(line) AS content FROM nw",
    "op_overlaps": """
SELECT a.l_orderkey, CAST(a.l_linenumber AS BIGINT) AS a_id, CAST(b.l_linenumber AS BIGINT) AS b_id FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey
WHERE a.l_linenumber % 2 = 0 AND b.l_linenumber % 2 = 1 AND a.l_linenumber % 3 = b.l_linenumber % 3 AND a.l_partkey % 2 = b.l_partkey % 2""",
    "progress_percent": """
SELECT source, count(quality) AS covered, count(*) AS total, CAST(least(floor(count(quality) * 100 / count(*) + 0.5), 100) AS BIGINT) AS percent
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""",
    "match_confidence": """
WITH r AS (SELECT source, sum(quality)::DOUBLE / count(*) AS ratio FROM documents JOIN labels USING (doc_id) GROUP BY source)
SELECT source, round(ratio, 6) AS ratio, CASE WHEN ratio >= 1 THEN 'exact' WHEN ratio >= 0.9 THEN 'high' WHEN ratio >= 0.5 THEN 'partial' ELSE 'none' END AS tier FROM r""",
    "target_places": r"""
WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS a FROM benchmark),
t AS (SELECT item_id, unnest(a) AS word, unnest(range(len(a))) AS idx FROM w),
n AS (SELECT *, regexp_replace(word, '^[^\p{L}\p{N}''’]+|[^\p{L}\p{N}''’]+$', '', 'g') AS norm FROM t),
s AS (SELECT *, row_number() OVER (PARTITION BY item_id, norm ORDER BY idx) AS slot FROM n)
SELECT d.item_id, d.word, CAST(s.idx AS BIGINT) AS place FROM (SELECT DISTINCT item_id, word, norm FROM n) d LEFT JOIN s ON s.item_id = d.item_id AND s.norm = d.norm AND s.slot = 2""",
    "checklist_items": "SELECT n_name AS book, CAST(v AS BIGINT) AS verse, n_name || ':' || v AS id, 'pending' AS status FROM (SELECT n_name, unnest(range(1, n_nationkey % 7 + 1)) AS v FROM nation)",
    "checklist_updates": """
WITH i AS (SELECT n_name || ':' || v AS id, v FROM (SELECT n_name, unnest(range(1, n_nationkey % 7 + 1)) AS v FROM nation))
SELECT id, CASE WHEN v = 2 THEN 'done' ELSE 'pending' END AS status FROM i UNION ALL SELECT r_name || ':1', 'pending' FROM region WHERE r_name || ':1' NOT IN (SELECT id FROM i)""",
    "upsert_threads": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0",
    "json_field": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "help_references": """
WITH r AS (SELECT l_orderkey, l_linenumber, l_linenumber = 7 AS f, l_partkey % 4 AS c, l_quantity > 45 AS i, l_suppkey % 5 AS v FROM lineitem),
k AS (SELECT *, CASE WHEN f AND i THEN 'book intro' WHEN NOT f AND c > 0 AND i THEN 'chapter intro' WHEN NOT f AND c > 0 AND NOT i AND v > 0 THEN 'verse' END AS kind FROM r)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, kind, CASE WHEN kind IN ('chapter intro', 'verse') THEN CAST(c AS BIGINT) END AS chapter, CASE WHEN kind = 'verse' THEN CAST(v AS BIGINT) END AS verse FROM k""",
    "rc_links": """
WITH t AS (SELECT p_partkey, replace(lower(p_type), ' ', '-') AS w FROM part)
SELECT p_partkey, 'rc://en/tw/dict/bible/kt/' || w AS link, 'en' AS language, 'tw' AS resource, 'dict' AS type, 'bible/kt/' || w AS entry,
  array_to_string(list_transform(string_split(w, '-'), lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), ' ') AS title FROM t
UNION ALL SELECT p_partkey, 'rc://*/ta/man/translate/x' || p_partkey, '*', 'ta', 'man', 'translate/x' || p_partkey, 'X' || p_partkey FROM t""",
    "window_stream_counts": "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL",
}
