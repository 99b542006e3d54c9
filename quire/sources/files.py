"""Readers and writers of the text formats around scripture projects, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import escape_tsv
from quire.operators import helps, trees

# Fixed column names of the alignment table format.
ALIGNMENT_COLUMNS = ("Book", "Chapter", "Verse", "Source", "SourceOcc", "SourceStrong", "Target", "TargetOcc", "Lemma", "Morph")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files, one row each."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, line): lines of each text, from 0."""
    return rows.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("n", "line"))


def read_tsv(rows: DataFrame, key: str, text: str, wanted: dict[str, tuple[str, ...]]) -> DataFrame:
    """(key, n, one column for each of ``wanted``) from tab-separated texts with a header line; cells aren't quoted.

    ``wanted`` maps a column's name to the header names it may have, compared without case; a missing column is null.
    """
    cells = lines(rows, key, text).where("trim(line) <> ''").withColumn("cells", F.split("line", "\t"))
    head = F.first("cells").over(W.partitionBy(key).orderBy("n"))
    cells = cells.withColumns({"head": F.transform(head, lambda h: F.lower(F.trim(h))), "row": F.row_number().over(W.partitionBy(key).orderBy("n"))})
    place = lambda names: F.greatest(*[F.array_position("head", x.lower()) for x in names]) if len(names) > 1 else F.array_position("head", names[0].lower())
    value = lambda names: F.get("cells", (place(names) - 1).cast("int"))
    return cells.where("row > 1").select(key, "n", *[value(names).alias(name) for name, names in wanted.items()])


def read_word_links(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Word-link rows with parsed reference, occurrence and link; rows without a valid reference are left out."""
    names = {"reference": ("Reference",), "id": ("ID",), "tags": ("Tags",), "quote": ("OrigWords", "Quote"), "occurrence": ("Occurrence",), "support": ("TWLink", "SupportReference")}
    return _help_rows(read_tsv(rows, key, text, names))


def read_notes(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Note rows likewise, with their note."""
    names = {"reference": ("Reference",), "id": ("ID",), "tags": ("Tags",), "support": ("SupportReference",), "quote": ("Quote",), "occurrence": ("Occurrence",), "note": ("Note",)}
    return _help_rows(read_tsv(rows, key, text, names))


def _help_rows(rows: DataFrame) -> DataFrame:
    made = rows.withColumns({"ref": helps.parse_reference(F.col("reference")), "occurrence": helps.occurrence(F.coalesce("occurrence", F.lit(""))), "link": helps.support_link(F.coalesce("support", F.lit("")))})
    return made.where("ref.kind IS NOT NULL")


def _count(text: Column, character: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))


def _pairs(words: Column, occurrences: Column) -> Column:
    """+-joined words with their n/total pairs as array<struct<word, occurrence, occurrences>>. Where each word has its pair of
    numbers it takes no lambda, which Spark interprets."""
    word = F.split(words, r"\+").alias("word")
    side = lambda other, name: F.split(F.regexp_replace(occurrences, other, ""), r"\+").cast("array<int>").alias(name)
    whole = occurrences.rlike(r"^\d{1,9}/\d{1,9}(?:\+\d{1,9}/\d{1,9})*+\z") & (_count(words, "+") <= _count(occurrences, "+"))
    pair = lambda o, k: F.coalesce(F.get(F.split(o, "/"), F.lit(k)).try_cast("int"), F.lit(1))
    any_ = F.transform(F.arrays_zip(word, F.split(occurrences, r"\+").alias("o")), lambda x: F.struct(x["word"].alias("word"), pair(x["o"], 0).alias("occurrence"), pair(x["o"], 1).alias("occurrences")))
    return F.when(whole, F.arrays_zip(word, side("/[^+]*", "occurrence"), side("[^+]*/", "occurrences"))).otherwise(any_)


def read_alignment_tsv(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, sid, sources, targets): a group for each line with at least 8 cells; a header line is skipped."""
    # lines are chosen by their tabs, so that each is split once
    head = (F.col("n") == 0) & (F.lower(F.substring_index("line", "\t", 1)) == "book")
    cells = lines(rows, key, text).where((_count(F.col("line"), "\t") >= 7) & ~head).withColumn("c", F.split("line", "\t"))
    c = lambda k: F.get("c", F.lit(k))
    sid = F.concat(c(0), F.lit(" "), c(1), F.lit(":"), c(2))
    return cells.select(key, "n", sid.alias("sid"), _pairs(c(3), c(4)).alias("sources"), F.split(c(5), r"\+").alias("strongs"), _pairs(c(6), c(7)).alias("targets"), c(8).alias("lemmas"), c(9).alias("morphs"))


def write_alignment_tsv(groups: DataFrame, keep: tuple[str, ...] = ("sid",)) -> DataFrame:
    """(keep, line) from (sid, sources, strongs, targets, lemmas, morphs)."""
    sid = lambda k: F.regexp_extract("sid", r"^(\S+) ([^:]+):(.+)$", k)
    word = lambda a: F.array_join(F.col(a)["word"], "+")
    pair = lambda x: F.concat_ws("/", x["occurrence"].cast("string"), x["occurrences"].cast("string"))
    # groups of one or two words, as nearly all are, take no lambda
    few = lambda a: F.concat_ws("+", *[F.when(F.size(a) > k, pair(F.get(a, F.lit(k)))) for k in range(2)])
    occ = lambda a: F.when(F.size(a).between(0, 2), few(a)).otherwise(F.array_join(F.transform(a, pair), "+"))
    fields = [sid(1), sid(2), sid(3), word("sources"), occ("sources"), F.array_join("strongs", "+"), word("targets"), occ("targets"), F.coalesce("lemmas", F.lit("")), F.coalesce("morphs", F.lit(""))]
    line = F.col("__line")
    there = F.col("sid").isNotNull() & F.col("sources").isNotNull() & F.col("strongs").isNotNull() & F.col("targets").isNotNull()
    # the fields are looked at one by one only where one of them may need quotes
    plain = there & (_count(line, "\t") == len(fields) - 1) & ~line.rlike('["\n\r]')
    escaped = F.array_join(F.transform(F.array(*fields), escape_tsv), "\t")
    return groups.withColumn("__line", F.concat_ws("\t", *fields)).select(*keep, F.when(plain, line).otherwise(escaped).alias("line"))


def read_alignment_text(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, sid, sources, targets) from sections ``== sid ==`` with lines ``sources → targets``."""
    r = lines(rows, key, text).withColumn("head", F.nullif(F.regexp_extract("line", r"^==\s*(.+?)\s*==\s*$", 1), F.lit("")))
    sid = F.last("head", ignorenulls=True).over(W.partitionBy(key).orderBy("n").rowsBetween(W.unboundedPreceding, 0))
    side = lambda k: F.filter(F.split(F.trim(F.regexp_extract("line", r"^(.*?)\s*→\s*(.*)$", k)), r"\s+"), lambda w: w != "")
    r = r.withColumn("sid", sid).where("head IS NULL AND sid IS NOT NULL AND contains(line, '→')")
    return r.select(key, "n", "sid", side(1).alias("sources"), side(2).alias("targets"))


def write_alignment_text(groups: DataFrame, key: str) -> DataFrame:
    """(key, text) from (key, sid, n, sources, targets): the sections that ``read_alignment_text`` reads, verses in order of their
    first line."""
    line = F.concat(F.array_join("sources", " "), F.lit(" → "), F.array_join("targets", " "))
    verse = groups.groupBy(key, "sid").agg(F.min("n").alias("n"), F.array_sort(F.collect_list(F.struct(F.col("n"), line.alias("t")))).alias("l"))
    part = F.concat(F.lit("== "), "sid", F.lit(" ==\n"), F.array_join(F.transform("l", lambda x: x["t"]), "\n"), F.lit("\n"))
    return verse.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", part.alias("t")))), lambda x: x["t"]), "\n").alias("text"))


def write_alignment_json(groups: DataFrame, key: str, translation: str, source: str) -> DataFrame:
    """(key, text) from (key, sid, group, sources, targets): JSON documents that ``alignment.groups_json`` reads."""
    # dealt by document once, all groups of a document come together anyhow
    groups = groups.where(F.col(key).isNotNull()).repartition(key)
    ident = lambda c: F.first(c).alias(c)
    verse = groups.groupBy(key, "sid").agg(F.transform(F.array_sort(F.collect_list(F.struct("group", "sources", "targets"))), lambda x: F.struct(x["sources"].alias("sources"), x["targets"].alias("targets"))).alias("g"), ident(translation), ident(source))
    verses = verse.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("sid", "g")))).alias("verses"), ident(translation), ident(source))
    about = lambda c: F.struct(F.col(c).alias("id")).alias(c)
    document = F.struct(F.lit("usfm-alignment").alias("format"), F.lit("1.0").alias("version"), about(translation), about(source), "verses")
    return verses.select(key, F.concat(F.to_json(document), F.lit("\n")).alias("text"))


ENTRY = "id string, userId string, timestamp bigint, sequence bigint, vectorClock map<string, bigint>, chapter int, layer string, operations string, baseSnapshotId string"


def read_journal(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, entry fields) from JSON lines; a header line, blank lines and lines that don't parse are skipped."""
    r = lines(rows, key, text).withColumn("e", F.from_json("line", ENTRY, {"mode": "PERMISSIVE"}))
    return r.where("e.id IS NOT NULL AND get_json_object(line, '$._journalHeader') IS NULL").select(key, "n", "e.*")


def write_journal(entries: DataFrame) -> DataFrame:
    """(id, line): entries as JSON lines."""
    return entries.select("id", F.to_json(F.struct(*[c for c in entries.columns if c not in ("n", "path")])).alias("line"))


CHECK = "meta struct<book: string, schemaVersion: string>, entries array<struct<id: string, ref: string, author: string, timestamp: string, supersedes: string, type: string, text: string>>"


def read_checking(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, book, entry fields); entries without id, reference, author or type are dropped."""
    r = rows.select(key, F.from_json(text, CHECK).alias("d")).select(key, "d.meta.book", F.explode("d.entries").alias("e")).select(key, "book", "e.*")
    return r.where("id IS NOT NULL AND ref IS NOT NULL AND author IS NOT NULL AND type IS NOT NULL")


def read_burrito(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, code): books of a Scripture Burrito manifest, from the ingredients' scopes, else from their file names."""
    schema = "ingredients map<string, struct<checksum: map<string, string>, scope: map<string, array<string>>>>"
    r = rows.select(key, F.explode(F.map_entries(F.from_json(text, schema)["ingredients"])).alias("i")).select(key, F.col("i.key").alias("path"), F.explode_outer(F.map_keys("i.value.scope")).alias("scope"))
    named = F.upper(F.regexp_extract("path", r"(?:^|/)(?:\d\d-)?([A-Za-z0-9]{3})\.(?:usfm|sfm)$", 1))
    return r.select(key, "path", F.coalesce(F.upper("scope"), F.nullif(named, F.lit(""))).alias("code")).where("code IS NOT NULL").dropDuplicates([key, "code"])


def read_container(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, code, path, sort): books of a Resource Container manifest (block-style YAML), in order of sort and code."""
    r = lines(rows, key, text)
    w = W.partitionBy(key).orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    r = r.withColumn("item", F.count(F.when(F.col("line").rlike(r"^\s*-\s*$|^\s*-\s+\w+:"), 1)).over(w))
    field = lambda name: F.max(F.nullif(F.regexp_extract("line", rf"^\s*(?:-\s+)?{name}:\s*['\"]?([^'\"]*)['\"]?\s*$", 1), F.lit("")))
    r = r.groupBy(key, "item").agg(F.upper(field("identifier")).alias("code"), field("path").alias("path"), field("sort").cast("int").alias("sort"))
    return r.where("lower(path) RLIKE '[.]u?sfm$'").select(key, "code", "path", "sort").orderBy(key, "sort", "code")


def read_usx(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text): XML books as tagged text, by their tree tables (``trees.read_xml``, ``trees.to_tagged``)."""
    return trees.to_tagged(trees.read_xml(rows, key, text), key).select(key, F.regexp_replace("text", r"\s+$", "").alias("text"))
