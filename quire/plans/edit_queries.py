"""Queries over merges, operations on trees, chapters, alignment sources, similarity of trees, books and repositories."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import alignment, catalog, helps, journal, similarity, versions
from quire.operators.tokens import token_table
from quire.sources.tables import table


def usj_similarity(spark, sf_dir):
    """Messages and the next ones of their conversations as JSON trees: one paragraph, and for even turns of the next one a note."""
    c = table(spark, sf_dir, "conversations")
    after = F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))
    rows = c.select("conv_id", "turn", "text", after.alias("after")).where("after IS NOT NULL")
    leaf = lambda kind, t: F.concat(F.lit('{"type":"%s","content":[' % kind), F.to_json(F.array(t)).substr(F.lit(2), F.length(F.to_json(F.array(t))) - 2), F.lit("]}"))
    tree = lambda *parts: F.concat(F.lit('{"type":"USJ","version":"3.1","content":['), F.concat_ws(",", *parts), F.lit("]}"))
    note = F.when(F.col("turn") % 2 == 0, F.lit('{"type":"note","content":"zz"}'))
    rows = rows.select("conv_id", "turn", tree(leaf("para", F.col("text"))).alias("a"), tree(leaf("para", F.col("after")), note).alias("b"))
    rows = similarity.usj_similarity(rows, "a", "b", "r")
    return rows.select("conv_id", "turn", "r.ok", F.round("r.text_similarity", 6).alias("text"), F.round("r.structure_similarity", 6).alias("structure"), F.round("r.score", 6).alias("score"), F.size("r.messages").cast("long").alias("faults"))


def _order_xml(spark, sf_dir):
    """(o_orderkey, xml): an order with its lines; every eleventh isn't XML."""
    li = table(spark, sf_dir, "lineitem")
    name = F.when(F.col("l_returnflag") == "R", "back").otherwise("line")
    one = F.concat(F.lit("<"), name, F.lit(' qty="'), F.col("l_quantity").cast("int").cast("string"), F.lit('" status="'), "l_linestatus", F.lit('"/>'))
    lines = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", (F.col("l_returnflag") != "R").alias("b"), F.col("l_quantity").cast("int").alias("q"), "l_linestatus", one.alias("x")))).alias("l"))
    o = table(spark, sf_dir, "orders").join(lines, "o_orderkey")
    inner = F.array_join(F.transform("l", lambda x: x["x"]), " text ")
    xml = F.concat(F.lit('<?xml version="1.0"?><order state="'), "o_orderstatus", F.lit('" id="'), F.col("o_orderkey").cast("string"), F.lit('">'), inner, F.lit("</order>"))
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, "<order>").otherwise(xml).alias("xml"))


def usx_similarity(spark, sf_dir):
    """Each order as XML against the order of the next key."""
    a = _order_xml(spark, sf_dir)
    b = a.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("xml").alias("other"))
    rows = similarity.usx_similarity(a.join(b, "o_orderkey"), "xml", "other", "r")
    return rows.select("o_orderkey", "r.ok", *[similarity.rounded(F.col(f"r.{c}"), 9).alias(c) for c in ("structure", "attributes", "tags", "score")], F.size("r.messages").cast("long").alias("faults"))


def help_normal(spark, sf_dir):
    words = token_table(table(spark, sf_dir, "documents"), "doc_id", "text").select("surface").distinct()
    return words.select("surface", T.help_text(F.col("surface")).alias("norm"))


def file_urls(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    path = T.fill_path(F.lit("/{book}//tn_{book}.tsv"), book=F.upper(F.substr("p_name", F.lit(1), F.lit(5))))
    host = F.when(F.col("p_size") % 3 == 0, "HTTPS://Git.Example.org/x").when(F.col("p_size") % 3 == 1, " ").otherwise("example.com")
    return p.select("p_partkey", T.raw_url(host, F.col("p_brand"), F.col("p_type"), F.lit("v1"), path, "git.example.com").alias("url"))


def headings_removed(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    text = F.concat(F.lit("intro\n # Title\n## Definition: x\n"), F.when(F.col("doc_id") % 2 == 0, "# Second\n").otherwise(""), F.col("text"), F.lit("\n## Definition: y"))
    return d.select("doc_id", T.without_heading(text).alias("heading"), T.without_heading(text, True).alias("definition"))


def sid_ranges(spark, sf_dir):
    """Verse ids made from order lines, taken apart, and whether they lie between 1:3 and 3:2."""
    li = table(spark, sf_dir, "lineitem")
    sid = F.when(F.col("l_suppkey") % 9 == 0, "no sid").when(F.col("l_suppkey") % 9 == 1, F.concat((F.col("l_partkey") % 5).cast("string"), F.lit(":"), F.col("l_linenumber").cast("string"))).otherwise(F.concat(F.lit("TIT "), (F.col("l_partkey") % 5).cast("string"), F.lit(":"), F.col("l_linenumber").cast("string")))
    rows = li.select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), T.split_sid(sid).alias("s"))
    return rows.select("l_orderkey", "line", "s.book", "s.chapter", "s.verse", T.in_range(F.col("s.chapter"), F.col("s.verse"), (1, 3), (3, 2)).alias("inside"))


def books_of_codes(spark, sf_dir):
    """Book codes from nations and a few real ones, with testament and source language."""
    n = table(spark, sf_dir, "nation")
    code = F.get(F.array(*[F.lit(x) for x in ("gen", " TIT ", "3JN", "XXA", "mal", "MAT")]), (F.col("n_nationkey") % 6).cast("int"))
    return catalog.with_book(n.select("n_nationkey", code.alias("code")), "code")


def language_names(spark, sf_dir):
    """A language table as JSON made from nations."""
    n = table(spark, sf_dir, "nation")
    item = F.to_json(F.struct(F.when(F.col("n_nationkey") % 5 == 0, " ").otherwise(F.lower("n_name")).alias("lc"), F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.initcap("n_name")).alias("ln"), F.when(F.col("n_nationkey") % 4 == 0, None).otherwise(F.initcap("n_name")).alias("ang"), F.when(F.col("n_nationkey") % 2 == 0, "rtl").otherwise("ltr").alias("ld")))
    rows = n.groupBy("n_regionkey").agg(F.concat(F.lit("["), F.array_join(F.collect_list(item), ","), F.lit("]")).alias("json"))
    return catalog.language_names(rows, "json")


def likely_projects(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    name = F.when(F.col("c_custkey") % 7 == 0, " .Profile").when(F.col("c_custkey") % 7 == 1, F.upper("c_mktsegment")).when(F.col("c_custkey") % 7 == 2, " ").otherwise(F.col("c_name"))
    repos = c.select("c_custkey", name.alias("name"), F.lower("c_mktsegment").alias("owner"), (F.col("c_nationkey") == 3).alias("archived"), F.when(F.col("c_nationkey") > 20, True).alias("empty"))
    return catalog.likely_projects(repos).select("c_custkey")


def alignment_folders(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    path = F.concat(F.when(F.col("n_nationkey") % 4 == 0, "Alignments\\").otherwise("alignments/"), F.lower(F.substr("n_name", F.lit(1), F.lit(2))), F.when(F.col("n_nationkey") % 3 == 0, "/tit.json").otherwise("/tit.alignment.json"))
    return catalog.alignment_sources(n.select(path.alias("path")), "path")


def release_pins(spark, sf_dir):
    """Customers pin their orders' newest release unless they hold one; what may be cleared is counted with it."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo"), "o_orderdate", F.col("o_orderkey").alias("tag"))
    c = table(spark, sf_dir, "customer")
    pins = c.select(F.col("c_nationkey").cast("long").alias("project"), F.col("c_custkey").alias("repo"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).alias("pinned"))
    made = catalog.pin(pins, o, "project", "repo", "o_orderdate", "tag")
    free = catalog.unpinned(o.select("repo", "tag"), catalog.upgrade(made), "repo", "tag").groupBy("repo").agg(F.count("*").alias("free"))
    return made.join(free, "repo", "left").select("project", "repo", "pinned", "available", F.coalesce("free", F.lit(0)).alias("free"))


def merged_files(spark, sf_dir):
    """Three versions of files of several kinds made from customers."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    path = F.concat(F.lit("f"), k.cast("string"), F.get(F.array(*[F.lit(x) for x in (".md", ".json", ".png", "/LICENSE")]), (k % 4).cast("int")))
    body = lambda mark: F.when(k % 4 == 1, F.concat(F.lit('{"a": "'), "c_name", F.lit(mark))).otherwise(F.concat("c_name", F.lit(mark)))
    base = body('"}')
    ours = F.when(k % 3 == 0, base).when(k % 3 == 1, body('o"}')).otherwise(body('" }'))
    theirs = F.when(k % 5 == 0, base).when(k % 5 == 1, body('o"}')).when(k % 5 == 2, body(' x"}')).otherwise(body('"\n}'))
    # some versions haven't the file at all
    there = lambda side, gone: F.when(k % 11 != gone, side)
    files = c.select(path.alias("path"), F.when(~(k % 11).isin(1, 2), base).alias("base"), F.when(k % 7 > 0, there(ours, 2)).alias("ours"), F.when(k % 13 > 0, there(theirs, 3)).alias("theirs"))
    return versions.merge_files(files)


def merged_books(spark, sf_dir):
    """Books of two chapters with a verse changed on each side: the same one for every third, else different ones."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    book = lambda one, two, more="": F.concat(F.lit("\\id TIT\n\\c 1\n\\p\n\\v 1 "), one, F.lit("\n\\v 2 second\n\\c 2\n\\p\n\\v 1 "), two, F.lit("\n" + more))
    name, other = F.col("c_name"), F.concat("c_name", F.lit("!"))
    ours = book(other, name)
    theirs = F.when(k % 3 == 0, book(F.lit("theirs"), name)).when(k % 3 == 1, book(name, F.lit("theirs"))).otherwise(book(name, name, "\\q\n\\v 2 more\n"))
    files = c.select(F.concat(F.lit("b"), k.cast("string"), F.lit(".usfm")).alias("path"), book(name, name).alias("base"), ours.alias("ours"), theirs.alias("theirs"))
    return versions.merge_files(files).select("path", "kind", "text", F.regexp_extract("conflict", "#(.*)-[0-9a-z]+-[0-9a-z]+$", 1).alias("chapters"))


def ops_transformed(spark, sf_dir):
    """Edits by an order's other lines after the edit by its first line."""
    li = _lines(spark, sf_dir)
    op = F.get(F.array(*[F.lit(x) for x in ("insertNode", "removeNode", "replaceNode", "setText", "setAttr", "alignWord")]), (F.col("l_partkey") % 6).cast("int"))
    path = F.array(F.lit(0), (F.col("l_suppkey") % 3).cast("int"))
    none = F.lit(None).cast("string")
    ops = li.select("l_orderkey", F.col("l_linenumber").cast("long").alias("seq"), op.alias("op"), path.alias("path"), F.lit(None).cast("array<int>").alias("to"), F.lit("k").alias("attr"), F.col("l_returnflag").alias("value"), none.alias("old"))
    got = versions.transform(ops.where("seq > 1"), ops.where("seq = 1"), ["l_orderkey"])
    return got.select("l_orderkey", "seq", "op", F.element_at("path", 2).cast("long").alias("place"), "old")


def ops_inverted(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    op = F.get(F.array(*[F.lit(x) for x in ("insertNode", "removeNode", "moveNode", "setText", "updateGroup")]), (F.col("l_partkey") % 5).cast("int"))
    ops = li.select("l_orderkey", F.col("l_linenumber").cast("long").alias("seq"), op.alias("op"), F.array("l_linenumber").alias("path"), F.array(F.lit(9)).alias("to"), F.lit(None).cast("string").alias("attr"), F.lit("new").alias("value"), F.when(F.col("l_suppkey") % 2 == 0, "was").alias("old"))
    got = versions.invert(ops, ["l_orderkey"], "seq")
    return got.select("l_orderkey", "seq", "op", F.get("path", F.lit(0)).cast("long").alias("place"), "value", "old")


def _lines(spark, sf_dir):
    """Order lines, the least of those that share order and number."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_quantity").alias("l_quantity"), F.min("l_suppkey").alias("l_suppkey"), F.min("l_returnflag").alias("l_returnflag"))


def ops_by_chapter(spark, sf_dir):
    """Two lists of an order's lines composed, and grouped by order."""
    li = _lines(spark, sf_dir).select("l_orderkey", F.col("l_linenumber").cast("long").alias("seq"), F.col("l_partkey").alias("value"))
    made = versions.compose(li.where("seq % 2 = 0"), li.where("seq % 2 = 1"), ["l_orderkey"], "seq")
    return versions.by_chapter(made, ["l_orderkey"], "seq").select("l_orderkey", F.array_join(F.transform("ops", lambda o: F.concat(o["seq"].cast("string"), F.lit(":"), o["value"].cast("string"))), " ").alias("ops"))


def _chapters(spark, sf_dir):
    li = _lines(spark, sf_dir)
    return li.withColumn("q", F.floor("l_quantity").cast("long") % 4).select(F.col("l_orderkey").alias("book"), F.col("q").alias("chapter"), F.col("l_linenumber").cast("long").alias("place"), F.col("l_partkey").alias("content"))


def chapter_edits(spark, sf_dir):
    """Books of order lines with chapter 1 replaced where it exists, chapter 3 deleted, and chapter 2 then moved to 7."""
    rows = _chapters(spark, sf_dir)
    books = rows.select("book").distinct()
    new = books.select("book", F.lit(1).cast("long").alias("chapter"), F.lit(0).cast("long").alias("place"), F.lit(-1).cast("long").alias("content"))
    number = lambda n: F.lit(n).cast("long")
    moves = books.select("book", number(2).alias("chapter"), number(7).alias("new"))
    return versions.edit_chapters(rows, "book", new, books.withColumn("chapter", number(3)), moves)


def chapters_merged(spark, sf_dir):
    """Chapter 2 of each book at the end of the chapter before it."""
    rows = _chapters(spark, sf_dir)
    return versions.merge_into_previous(rows, rows.select("book").distinct().withColumn("chapter", F.lit(2)), "book")


def source_match(spark, sf_dir):
    """Words of order lines as alignment sources against tokens made from them, some changed, some verses missing."""
    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_partkey")
    sid = F.concat(F.lit("TIT 1:"), F.col("l_orderkey").cast("string"))
    own = li.select(sid.alias("sid"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("G"), k.cast("string"))).alias("strong"), F.concat(F.lit("Lem"), F.col("l_suppkey").cast("string")).alias("lemma"), F.concat(F.lit("w"), k.cast("string"), F.lit(",")).alias("content"), F.lit(1).alias("occurrence"))
    there = li.where("l_orderkey % 5 <> 0")
    tok = there.select(F.concat(F.lit("tit  1:"), F.col("l_orderkey").cast("string")).alias("sid"), F.when(k % 4 == 0, "").when(k % 4 == 1, "G0").otherwise(F.concat(F.lit("g"), k.cast("string"))).alias("strong"), F.concat(F.lit("x"), F.col("l_suppkey").cast("string")).alias("lemma"), F.concat(F.lit("w"), k.cast("string")).alias("surface"), F.when(k % 4 == 0, 2).when(k % 3 == 0, 1).otherwise(2).alias("occurrence"))
    verses, _ = alignment.source_report(own, tok)
    return verses.select("sid", F.col("found").isNotNull().alias("found"), "words", "matched")


def source_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    word = lambda name: li.select(F.concat(F.lit("A 1:"), F.col("l_orderkey").cast("string")).alias("sid"), F.concat(F.lit("G"), F.col("l_linenumber").cast("string")).alias("strong"), F.lit("").alias("lemma"), F.lit("c").alias(name), F.col("l_linenumber").alias("occurrence"))
    _, total = alignment.source_report(word("content"), word("surface").where("occurrence < 6"))
    return total.select("confidence", F.round("match_ratio", 6).alias("match_ratio"), "verses_compared", "verses_matched")


def aligned_helps(spark, sf_dir):
    """A help for each benchmark item that quotes its third word and the next but one, found through a one-to-one alignment in
    which the translation runs backwards."""
    t = token_table(table(spark, sf_dir, "benchmark"), "item_id", "text").withColumn("norm", T.help_text(F.col("surface"))).where("norm <> ''")
    t = t.withColumn("flat", (F.row_number().over(W.partitionBy("item_id").orderBy("idx")) - 1).cast("int"))
    w = W.partitionBy("item_id", "norm").orderBy("flat")
    sources = t.select("item_id", "flat", F.col("flat").alias("group"), "norm", F.row_number().over(w).alias("occurrence"))
    last = F.max("flat").over(W.partitionBy("item_id"))
    turned = t.select("item_id", "norm", (last - F.col("flat")).alias("place"), F.col("flat").alias("group"))
    back = W.partitionBy("item_id", "norm").orderBy("place")
    targets = turned.select("item_id", "group", "norm", F.row_number().over(back).alias("occurrence"))
    word = lambda k: F.max(F.when(F.col("flat") == k, F.col("norm")))
    ask = t.groupBy("item_id").agg(F.concat(word(2), F.lit(" "), word(4)).alias("quote")).select("item_id", F.lit("h1").alias("id"), "quote", F.lit(1).alias("occurrence"))
    got = helps.match_by_alignment(ask, sources, targets, turned.select("item_id", "place", "norm"), ["item_id"])
    return helps.annotations_by_token(got, ["item_id"], "place", "id").select("item_id", F.col("place").cast("long").alias("place"), F.array_join("entries", ",").alias("entries"))


def group_edits(spark, sf_dir):
    """Order lines as alignment groups: lines 2 and 3 made part of group 1, then line 3 split off again, and group 5 removed."""
    li = _lines(spark, sf_dir)
    rows = li.select("l_orderkey", F.col("l_linenumber").cast("long").alias("group"), F.lit("target").alias("role"), F.col("l_linenumber").cast("long").alias("pos"), "l_partkey")
    part = lambda *g: rows.where(F.col("group").isin(*g)).select("l_orderkey", "group")
    out = alignment.merge_groups(rows, ["l_orderkey"], part(2, 3).withColumn("target_group", F.lit(1).cast("long")))
    out = alignment.split_groups(out, ["l_orderkey"], out.where("pos = 3").select("l_orderkey", "group", "pos"))
    return alignment.remove_groups(out, ["l_orderkey"], part(5)).select("l_orderkey", "group", "pos", "l_partkey")


def reconciled_groups(spark, sf_dir):
    """Every word of a turn aligned by itself; what is left after the turn lost its first two words and got another at its end."""
    words = token_table(table(spark, sf_dir, "benchmark"), "item_id", "text")
    old = words.select("item_id", F.col("idx").alias("place"), F.col("surface").alias("word"))
    new = old.where("place >= 2").withColumn("place", F.col("place") - 2)
    kept = new.select("item_id", (F.col("place") + 2).cast("int").alias("old"), F.col("place").cast("int").alias("new"))
    slots = alignment.numbered(old, ["item_id"], "word", "place")
    groups = slots.select("item_id", F.col("place").cast("long").alias("group"), F.lit(0).alias("target"), "word", F.col("slot").alias("occurrence"))
    got = alignment.reconcile(groups, kept, old, new, ["item_id"])
    return got.select("item_id", "group", "word", F.col("occurrence").cast("long").alias("occurrence"), "occurrences")


def journal_state(spark, sf_dir):
    """Users' settings as journal entries compacted into a snapshot of the first half, and hydrated from it with the rest."""
    e = table(spark, sf_dir, "events")
    snapshot = journal.snapshot(e.where("event_id % 2 = 0"), ["user_id", "event_type"], ["event_id"], "value")
    return journal.hydrate(snapshot, e.where("event_id % 2 = 1"), ["user_id", "event_type"], ["event_id"], "value").select("user_id", "event_type", F.round("value", 6).alias("value"))


def journal_sync(spark, sf_dir):
    """What two replicas of a log have to send each other, by their clocks."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).cast("long").alias("sequence"))
    ours, theirs = e.where("sequence % 5 <> 0 OR user_id % 2 = 0"), e.where("sequence <= 3")
    push, pull = journal.exchange(ours, theirs, "user_id", "sequence")
    return push.withColumn("way", F.lit("push")).unionByName(pull.withColumn("way", F.lit("pull"))).select("event_id", "way")


QUERIES = {
    f.__name__: f
    for f in (
        usj_similarity, usx_similarity, help_normal, file_urls, headings_removed, sid_ranges, books_of_codes, language_names, likely_projects, alignment_folders, release_pins, merged_files, merged_books,
        ops_transformed, ops_inverted, ops_by_chapter, chapter_edits, chapters_merged, source_match, source_summary, aligned_helps, group_edits, reconciled_groups, journal_state, journal_sync,
    )
}

_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
_CHAPTERS = "c AS (SELECT l_orderkey AS book, CAST(floor(l_quantity) AS BIGINT) % 4 AS chapter, CAST(l_linenumber AS BIGINT) AS place, l_partkey AS content FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2))"
_NORM = r"regexp_replace({0}, '^[^\p{{L}}\p{{N}}\p{{M}}]+|[^\p{{L}}\p{{N}}\p{{M}}]+$', '', 'g')"

ORACLE_SQL = {
    "usj_similarity": """
WITH p AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations),
q AS (SELECT conv_id, turn, a, trim(regexp_replace(after || CASE WHEN turn % 2 = 0 THEN ' zz' ELSE '' END, '\\s+', ' ', 'g')) AS b FROM p WHERE after IS NOT NULL),
x AS (SELECT conv_id, turn, g, count(*) AS n FROM (SELECT conv_id, turn, unnest(list_transform(range(1, length(a)), lambda i: substr(a, i, 2))) AS g FROM q) GROUP BY ALL),
y AS (SELECT conv_id, turn, g, count(*) AS n FROM (SELECT conv_id, turn, unnest(list_transform(range(1, length(b)), lambda i: substr(b, i, 2))) AS g FROM q) GROUP BY ALL),
s AS (SELECT conv_id, turn, sum(least(x.n, y.n)) AS k FROM x JOIN y USING (conv_id, turn, g) GROUP BY ALL),
r AS (SELECT conv_id, turn, CASE WHEN length(a) < 2 AND length(b) < 2 THEN CAST(a = b AS DOUBLE) ELSE 2 * coalesce(k, 0)::DOUBLE / (greatest(length(a) - 1, 0) + greatest(length(b) - 1, 0)) END AS t,
  CASE WHEN turn % 2 = 0 THEN 2 / (sqrt(2.0::DOUBLE) * sqrt(3.0::DOUBLE)) ELSE 1.0::DOUBLE END AS u, length(a) AS n, length(b) AS m FROM q LEFT JOIN s USING (conv_id, turn)),
z AS (SELECT *, 0.62::DOUBLE * t + 0.38::DOUBLE * u AS score, 0.62::DOUBLE * t + 0.38::DOUBLE * u >= 0.84 AND t >= 0.79 AND u >= 0.67 AS ok FROM r)
SELECT conv_id, turn, ok, round(t, 6) AS text, round(u, 6) AS structure, round(score, 6) AS score,
  CAST(m = 0 AND n > 0 AS BIGINT) + CAST(t < 0.79 AS BIGINT) + CAST(u < 0.67 AS BIGINT) + CAST(NOT ok AS BIGINT) AS faults FROM z""",
    "usx_similarity": """
WITH l AS (SELECT l_orderkey AS k, list({'n': CASE WHEN l_returnflag = 'R' THEN 'back' ELSE 'line' END, 'q': CAST(l_quantity AS INT), 's': l_linestatus} ORDER BY l_linenumber, l_partkey, l_returnflag = 'N' OR l_returnflag = 'A', CAST(l_quantity AS INT), l_linestatus) AS c FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey AS k, o_orderstatus AS st, c, o_orderkey % 11 = 0 AS bad FROM orders JOIN l ON k = o_orderkey),
p AS (SELECT a.k, a.c AS x, b.c AS y, a.bad OR b.bad AS bad, CAST(a.bad AS INT) + CAST(b.bad AS INT) AS nbad, CAST(a.st = b.st AS INT) / 2.0::DOUBLE AS ra FROM o a JOIN o b ON b.k = a.k + 1),
e AS (SELECT *, least(len(x), len(y)) AS m, list_transform(range(1, least(len(x), len(y)) + 1), lambda i: CASE WHEN x[i].n = y[i].n THEN (CAST(x[i].q = y[i].q AS INT) + CAST(x[i].s = y[i].s AS INT)) / 2.0::DOUBLE END) AS g FROM p),
h AS (SELECT *, (2.0::DOUBLE * m / (len(x) + len(y))) * (0.35 * ra + 0.65 * list_sum(list_transform(g, lambda v: CASE WHEN v IS NULL THEN 0.0::DOUBLE ELSE 0.35 * v + 0.65 END)) / m) AS st,
  (ra + coalesce(list_sum(g), 0)) / (1 + len(list_filter(g, lambda v: v IS NOT NULL))) AS att,
  len(list_filter(x, lambda v: v.n = 'back'))::DOUBLE AS xb, len(list_filter(x, lambda v: v.n = 'line'))::DOUBLE AS xl, len(list_filter(y, lambda v: v.n = 'back'))::DOUBLE AS yb, len(list_filter(y, lambda v: v.n = 'line'))::DOUBLE AS yl FROM e),
r AS (SELECT k, bad, nbad, CASE WHEN bad THEN 0 ELSE st END AS st, CASE WHEN bad THEN 0 ELSE att END AS att, CASE WHEN bad THEN 0 ELSE (1 + xb * yb + xl * yl) / (sqrt(1 + xb * xb + xl * xl) * sqrt(1 + yb * yb + yl * yl)) END AS tg FROM h),
z AS (SELECT *, 0.48::DOUBLE * st + 0.32::DOUBLE * att + 0.2::DOUBLE * tg AS score FROM r), w AS (SELECT *, NOT bad AND score >= 0.73 AND st >= 0.63 AND att >= 0.56 AND tg >= 0.52 AS ok FROM z)
SELECT k AS o_orderkey, ok, round(st, 9) AS structure, round(att, 9) AS attributes, round(tg, 9) AS tags, round(score, 9) AS score,
  CASE WHEN bad THEN CAST(nbad AS BIGINT) ELSE CAST(st < 0.63 AS BIGINT) + CAST(att < 0.56 AS BIGINT) + CAST(tg < 0.52 AS BIGINT) + CAST(NOT ok AS BIGINT) END AS faults FROM w""",
    "help_normal": rf"""
WITH t AS (SELECT DISTINCT unnest({_WORDS}) AS surface FROM documents)
SELECT surface, trim({_NORM.format("regexp_replace(nfc_normalize(surface), '[​‌‍⁠\ufeff֑-ֽ֯]', '', 'g')")}) AS norm FROM t""",
    "file_urls": """
SELECT p_partkey, 'https://' || CASE p_size % 3 WHEN 0 THEN 'git.example.org' WHEN 1 THEN 'git.example.com' ELSE 'example.com' END || '/' || replace(p_brand, '#', '%23') || '/' || replace(p_type, ' ', '%20') || '/raw/v1/'
  || replace(upper(substr(p_name, 1, 5)), ' ', '%20') || '/tn_' || replace(upper(substr(p_name, 1, 5)), ' ', '%20') || '.tsv' AS url FROM part""",
    "headings_removed": """
WITH t AS (SELECT doc_id, string_split(CASE WHEN doc_id % 2 = 0 THEN '# Second' || chr(10) ELSE '' END || text || chr(10) || '## Definition: y', chr(10)) AS rest FROM documents)
SELECT doc_id, 'intro' || chr(10) || '## Definition: x' || chr(10) || array_to_string(rest, chr(10)) AS heading, 'intro' || chr(10) || array_to_string(rest, chr(10)) AS definition FROM t""",
    "sid_ranges": """
WITH s AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, l_suppkey % 9 AS k, CASE WHEN l_suppkey % 9 <> 0 THEN l_partkey % 5 END AS c FROM lineitem)
SELECT l_orderkey, line, CASE WHEN k > 1 THEN 'TIT' ELSE '' END AS book, coalesce(CAST(c AS VARCHAR), '') AS chapter, CASE WHEN c IS NOT NULL THEN CAST(line AS VARCHAR) ELSE 'no sid' END AS verse,
  coalesce(c = 1 AND line >= 3 OR c = 2 OR c = 3 AND line <= 2, false) AS inside FROM s""",
    "books_of_codes": """
WITH c AS (SELECT n_nationkey, ['gen', ' TIT ', '3JN', 'XXA', 'mal', 'MAT'][CAST(n_nationkey % 6 AS INT) + 1] AS code, n_nationkey % 6 AS k FROM nation)
SELECT n_nationkey, code, CASE WHEN k IN (0, 4) THEN 'OT' WHEN k <> 3 THEN 'NT' END AS testament, CASE WHEN k IN (0, 4) THEN 'hbo' WHEN k <> 3 THEN 'el-x-koine' END AS source_language,
  CASE WHEN k IN (0, 4) THEN 'uhb' WHEN k <> 3 THEN 'ugnt' END AS resource FROM c""",
    "language_names": """
WITH n AS (SELECT n_nationkey AS k, lower(n_name) AS lc, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS nm FROM nation)
SELECT lc, CASE WHEN k % 3 <> 0 OR k % 4 <> 0 THEN nm ELSE lc END AS ln, CAST(NULL AS VARCHAR) AS ang, CASE WHEN k % 2 = 0 THEN 'rtl' END AS ld FROM n WHERE k % 5 <> 0""",
    "likely_projects": "SELECT c_custkey FROM customer WHERE c_custkey % 7 > 2 AND c_nationkey <> 3 AND c_nationkey <= 20",
    "alignment_folders": """
SELECT DISTINCT lower(substr(n_name, 1, 2)) AS source_language, 'alignments/' || lower(substr(n_name, 1, 2)) || '/' AS base_path FROM nation WHERE n_nationkey % 3 <> 0""",
    "release_pins": """
WITH n AS (SELECT o_custkey AS repo, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS newest FROM orders GROUP BY 1),
p AS (SELECT CAST(c_nationkey AS BIGINT) AS project, c_custkey AS repo, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_custkey END, newest) AS pinned,
  CASE WHEN c_custkey % 3 = 0 AND c_custkey <> newest THEN newest END AS available FROM customer LEFT JOIN n ON repo = c_custkey),
f AS (SELECT p.repo, count(*) AS free FROM p JOIN orders ON o_custkey = p.repo WHERE o_orderkey IS DISTINCT FROM coalesce(available, pinned) GROUP BY 1)
SELECT project, p.repo, pinned, available, coalesce(free, 0) AS free FROM p LEFT JOIN f ON f.repo = p.repo""",
    "merged_files": """
WITH f AS (SELECT c_custkey AS k, 'f' || c_custkey || ['.md', '.json', '.png', '/LICENSE'][CAST(c_custkey % 4 AS INT) + 1] AS path, CASE WHEN c_custkey % 4 = 1 THEN '{"a": "' ELSE '' END || c_name AS s FROM customer),
v AS (SELECT *, s || '"}' AS b, s || CASE k % 3 WHEN 0 THEN '"}' WHEN 1 THEN 'o"}' ELSE '" }' END AS o, s || CASE WHEN k % 5 = 0 THEN '"}' WHEN k % 5 = 1 THEN 'o"}' WHEN k % 5 = 2 THEN ' x"}' ELSE '"' || chr(10) || '}' END AS t FROM f),
j AS (SELECT *, k % 4 = 1 AS js, CASE k % 3 WHEN 1 THEN 'o' ELSE '' END AS jo, CASE k % 5 WHEN 1 THEN 'o' WHEN 2 THEN ' x' ELSE '' END AS jt FROM v),
g AS (SELECT * REPLACE (CASE WHEN k % 11 NOT IN (1, 2) THEN b END AS b, CASE WHEN k % 7 > 0 AND k % 11 <> 2 THEN o END AS o, CASE WHEN k % 13 > 0 AND k % 11 <> 3 THEN t END AS t) FROM j),
m AS (SELECT * REPLACE (coalesce(o, '') AS o, coalesce(t, '') AS t), CASE WHEN o IS NULL OR t IS NULL THEN CASE WHEN b IS NULL THEN 'merged' WHEN coalesce(o, t) = b THEN 'deleted' ELSE 'conflict' END END AS way,
  CASE WHEN o IS NULL OR t IS NULL THEN CASE WHEN b IS NULL THEN coalesce(o, t) END WHEN o = t THEN o WHEN b = o THEN t WHEN b = t THEN o WHEN b IS NULL THEN NULL WHEN js AND (jo = jt OR jt = '') THEN o WHEN js AND jo = '' THEN t END AS text FROM g WHERE o IS NOT NULL OR t IS NOT NULL),
h AS (SELECT *, list_transform([o, t], lambda x: CASE x WHEN '' THEN '0' ELSE lower(to_base(list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length(x) + 1), lambda i: unicode(substr(x, i, 1))::BIGINT)), lambda a, c: (a * 31 + c) % 4294967296), 36)) END) AS ids FROM m)
SELECT path, coalesce(way, CASE WHEN text IS NULL THEN 'conflict' ELSE 'merged' END) AS kind, text,
  CASE WHEN coalesce(way, CASE WHEN text IS NULL THEN 'conflict' END) = 'conflict' THEN path || '#0-' || ids[1] || '-' || ids[2] END AS conflict FROM h""",
    "merged_books": """
SELECT 'b' || c_custkey || '.usfm' AS path, CASE WHEN c_custkey % 3 = 0 THEN 'conflict' ELSE 'merged' END AS kind,
  CASE WHEN c_custkey % 3 > 0 THEN '\\id TIT' || chr(10) || '\\c 1' || chr(10) || '\\p' || chr(10) || '\\v 1 ' || c_name || '!' || chr(10) || '\\v 2 second' || chr(10) || '\\c 2' || chr(10) || '\\p' || chr(10) || '\\v 1 '
    || CASE c_custkey % 3 WHEN 1 THEN 'theirs' || chr(10) ELSE c_name || chr(10) || '\\q' || chr(10) || '\\v 2 more' || chr(10) END END AS text,
  CASE WHEN c_custkey % 3 = 0 THEN '0,1' END AS chapters FROM customer""",
    "ops_transformed": """
WITH o AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS seq, ['insertNode', 'removeNode', 'replaceNode', 'setText', 'setAttr', 'alignWord'][CAST(l_partkey % 6 AS INT) + 1] AS op, l_suppkey % 3 AS place, l_returnflag AS v FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2)),
j AS (SELECT m.*, p.op AS pop, p.place AS pp, p.v AS pv FROM o m LEFT JOIN o p ON p.l_orderkey = m.l_orderkey AND p.seq = 1 WHERE m.seq > 1)
SELECT l_orderkey, seq, op, CASE WHEN op = 'alignWord' THEN place WHEN pop = 'insertNode' AND place >= pp THEN place + 1 WHEN pop = 'removeNode' AND place > pp THEN place - 1 ELSE place END AS place,
  CASE WHEN op = 'setText' AND pop = 'setText' AND place = pp THEN pv END AS old
FROM j WHERE NOT coalesce(op <> 'alignWord' AND place = pp AND (pop = 'replaceNode' OR pop = 'setAttr' AND op = 'setAttr'), false)""",
    "ops_inverted": """
WITH o AS (SELECT l_orderkey, l_linenumber AS n, l_partkey % 5 AS k, l_suppkey % 2 = 0 AS w FROM lineitem)
SELECT l_orderkey, CAST(-n AS BIGINT) AS seq, ['removeNode', 'insertNode', 'moveNode', 'setText'][CAST(k AS INT) + 1] AS op, CAST(CASE WHEN k = 2 THEN 9 ELSE n END AS BIGINT) AS place, CASE WHEN w THEN 'was' END AS value, 'new' AS old
FROM o WHERE k < 4 AND (w OR k IN (0, 2))""",
    "ops_by_chapter": """
WITH p AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 2, l_linenumber) - 1 AS seq FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2))
SELECT l_orderkey, string_agg(seq || ':' || l_partkey, ' ' ORDER BY seq) AS ops FROM p GROUP BY 1""",
    "chapter_edits": f"""
WITH {_CHAPTERS}
SELECT book, CASE chapter WHEN 2 THEN 7 ELSE chapter END AS chapter, place, content FROM c WHERE chapter IN (0, 2)
UNION ALL SELECT DISTINCT book, 1::BIGINT, 0::BIGINT, -1::BIGINT FROM c WHERE chapter = 1""",
    "chapters_merged": f"""
WITH {_CHAPTERS},
b AS (SELECT book, max(chapter) AS before FROM c WHERE chapter < 2 GROUP BY 1),
m AS (SELECT c.*, row_number() OVER (PARTITION BY c.book, chapter ORDER BY place) AS r, before FROM c LEFT JOIN b ON b.book = c.book),
s AS (SELECT book, CASE WHEN chapter = 2 AND before IS NOT NULL THEN before ELSE chapter END AS too, chapter, place, content FROM m WHERE NOT (chapter = 2 AND before IS NOT NULL AND r = 1))
SELECT book, too AS chapter, row_number() OVER (PARTITION BY book, too ORDER BY chapter, place) - 1 AS place, content FROM s""",
    "source_match": """
WITH w AS (SELECT l_orderkey AS o, l_partkey AS k, l_orderkey % 5 <> 0 AS there FROM lineitem),
m AS (SELECT a.o, a.k, a.there, coalesce(a.there AND (a.k % 4 IN (2, 3) OR a.k % 4 = 1 AND a.k % 3 = 0), false) AS hit FROM w a)
SELECT 'TIT 1:' || o AS sid, bool_or(there) AS found, count(*) AS words, CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS matched FROM m GROUP BY o""",
    "source_summary": """
WITH w AS (SELECT l_orderkey AS o, count(*) AS n, count(*) FILTER (WHERE l_linenumber < 6) AS m FROM lineitem GROUP BY 1), r AS (SELECT sum(m)::DOUBLE / sum(n) AS x, count(*) AS v, count(*) FILTER (WHERE n = m) AS a FROM w)
SELECT CASE WHEN x >= 1 THEN 'exact' WHEN x >= 0.9 THEN 'high' WHEN x >= 0.5 THEN 'partial' ELSE 'none' END AS confidence, round(x, 6) AS match_ratio, v AS verses_compared, a AS verses_matched FROM r""",
    "aligned_helps": rf"""
WITH w AS (SELECT item_id, list_filter(list_transform({_WORDS}, lambda x: {_NORM.format("x")}), lambda x: x <> '') AS a FROM benchmark),
t AS (SELECT item_id, unnest(a) AS norm, unnest(range(len(a))) AS flat, len(a) - 1 AS last FROM w),
n AS (SELECT *, row_number() OVER (PARTITION BY item_id, norm ORDER BY flat) AS occ, row_number() OVER (PARTITION BY item_id, norm ORDER BY last - flat) AS back FROM t),
q AS (SELECT item_id, a[3] AS q1, a[5] AS q2 FROM w WHERE len(a) > 4),
s AS (SELECT q.item_id, q2, min(flat) AS a FROM q JOIN n ON n.item_id = q.item_id AND norm = q1 GROUP BY q.item_id, q2),
e AS (SELECT s.item_id, s.a, min(flat) AS nxt FROM s JOIN n ON n.item_id = s.item_id AND norm = q2 AND flat > s.a GROUP BY s.item_id, s.a)
SELECT DISTINCT n.item_id, CAST(last - flat AS BIGINT) AS place, 'h1' AS entries FROM e JOIN n ON n.item_id = e.item_id AND flat IN (a, nxt)""",
    "group_edits": """
WITH g AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS pos, l_partkey, CASE WHEN l_linenumber IN (2, 3) THEN 1 ELSE l_linenumber END AS g FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2)),
m AS (SELECT *, max(g) OVER (PARTITION BY l_orderkey) AS last FROM g)
SELECT l_orderkey, CAST(CASE WHEN pos = 3 THEN last + 1 ELSE g END AS BIGINT) AS "group", pos, l_partkey FROM m
WHERE NOT (CASE WHEN pos = 3 THEN last + 1 ELSE g END = 5 AND EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = m.l_orderkey AND x.l_linenumber = 5))""",
    "reconciled_groups": rf"""
WITH w AS (SELECT item_id, {_WORDS} AS a FROM benchmark), t AS (SELECT item_id, unnest(a) AS word, unnest(range(len(a))) AS idx FROM w),
n AS (SELECT *, regexp_replace(word, '^[^\p{{L}}\p{{N}}''’]+|[^\p{{L}}\p{{N}}''’]+$', '', 'g') AS norm FROM t)
SELECT item_id, CAST(idx AS BIGINT) AS "group", word, row_number() OVER (PARTITION BY item_id, norm ORDER BY idx) AS occurrence, count(*) OVER (PARTITION BY item_id, norm) AS occurrences FROM n WHERE idx >= 2""",
    "journal_state": """
SELECT user_id, event_type, round(coalesce(arg_max(value, event_id) FILTER (WHERE event_id % 2 = 1), arg_max(value, event_id)), 6) AS value FROM events GROUP BY ALL""",
    "journal_sync": """
WITH e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events),
o AS (SELECT * FROM e WHERE s % 5 <> 0 OR user_id % 2 = 0), t AS (SELECT * FROM e WHERE s <= 3), co AS (SELECT user_id, max(s) AS m FROM o GROUP BY 1), ct AS (SELECT user_id, max(s) AS m FROM t GROUP BY 1)
SELECT event_id, 'push' AS way FROM o LEFT JOIN ct USING (user_id) WHERE s > coalesce(m, 0) UNION ALL SELECT event_id, 'pull' FROM t LEFT JOIN co USING (user_id) WHERE s > coalesce(m, 0)""",
}
