"""Releases, pins, caches and where books come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.windows import latest

#: Languages that are written from right to left, whatever a language table says.
RTL = ("hbo", "arc", "ar", "fa", "ur", "he", "yi", "ps", "dv", "syr", "ku-arab")


def latest_release(releases: DataFrame, repo: list[str], when: str, tag: str) -> DataFrame:
    """The newest release of each repository, the larger tag of two at once."""
    return latest(releases, repo, [F.col(when).desc_nulls_last(), F.col(tag).desc()])


def updates_available(wanted: DataFrame, cached: DataFrame, on: list[str]) -> DataFrame:
    """Latest releases that aren't cached."""
    return wanted.join(cached, on, "left_anti")


def outdated(pins: DataFrame, current: DataFrame, on: list[str], version: str) -> DataFrame:
    """Pins whose source now has another version."""
    now = current.select(*on, F.col(version).alias("current_version"))
    return pins.join(now, on).where(F.col(version) != F.col("current_version")).distinct()


def sources_by_book(ingredients: DataFrame, book: str, order: str, source: str) -> DataFrame:
    """(book, source): of several ingredients of a book, the last counts."""
    return ingredients.groupBy(book).agg(F.max_by(source, order).alias(source))


def next_job(jobs: DataFrame, status: str, priority: str, created: str) -> DataFrame:
    """The queued job to run next."""
    return jobs.where(F.col(status) == "queued").orderBy(priority, created).limit(1)


def page(rows: DataFrame, order: list[str], size: int, number: int) -> DataFrame:
    """A page of a listing: 1 to 100 rows, page 1 to 60."""
    size, number = min(max(size, 1), 100), min(max(number, 1), 60)
    return rows.orderBy(*order).offset(size * (number - 1)).limit(size)


def read_through(keys: DataFrame, tiers: list[DataFrame], on: list[str], value: str) -> DataFrame:
    """``keys`` with the value of the first tier that has one, and tier (from 1, 0 for none)."""
    out = keys
    for k, t in enumerate(tiers):
        out = out.join(t.select(*on, F.col(value).alias(f"__{k}")), on, "left")
    found = [F.col(f"__{k}") for k in range(len(tiers))]
    tier = F.lit(0)
    for k in range(len(tiers) - 1, -1, -1):
        tier = F.when(found[k].isNotNull(), k + 1).otherwise(tier)
    return out.select(*keys.columns, F.coalesce(*found).alias(value), tier.alias("tier"))


def direction(language: Column, listed: Column | None = None) -> Column:
    """Writing direction of a language tag: rtl if it or its first part is one of ``RTL``, or by ``listed``, what a language
    table says of the tag. Null and blank tags are ltr."""
    tag = F.lower(F.trim(language))
    rtl = tag.isin(*RTL) | F.split(tag, "-")[0].isin(*RTL)
    return F.when(rtl if listed is None else rtl | F.coalesce(listed == "rtl", F.lit(False)), "rtl").otherwise("ltr")


def with_direction(rows: DataFrame, language: str, langnames: DataFrame, into: str = "direction") -> DataFrame:
    """``rows`` with the direction of their language, by ``language_names`` where it isn't among ``RTL``."""
    known = langnames.select(F.lower("lc").alias("__lc"), F.col("ld").alias("__ld")).dropDuplicates(["__lc"])
    joined = rows.join(known, F.lower(F.trim(language)) == F.col("__lc"), "left")
    return joined.withColumn(into, direction(F.col(language), F.col("__ld"))).drop("__lc", "__ld")


def language_names(rows: DataFrame, text: str) -> DataFrame:
    """(lc, ln, ang, ld) from JSON arrays of languages: without a code an item is left out, its name falls back to the English
    one and to the code; the English name only where it differs; ld only if rtl."""
    kind = "array<struct<lc: string, ln: string, ang: string, ld: string>>"
    item = rows.select(F.explode(F.from_json(text, kind)).alias("i")).select("i.*")
    said = lambda c: F.when(F.trim(c) != "", F.trim(c))
    named = item.select(said("lc").alias("lc"), F.coalesce(said("ln"), said("ang"), said("lc")).alias("ln"), said("ang").alias("ang"), F.when(F.col("ld") == "rtl", "rtl").alias("ld"))
    return named.where("lc IS NOT NULL").select("lc", "ln", F.when(F.col("ang") != F.col("ln"), F.col("ang")).alias("ang"), "ld")


def likely_projects(repos: DataFrame) -> DataFrame:
    """Repositories (name, owner, archived, empty) that may be projects: neither a profile, nor named like their owner, nor
    archived or empty. Nulls in the last two read as no."""
    name = F.lower(F.trim("name"))
    placeholder = (name == ".profile") | F.coalesce(name == F.lower(F.trim("owner")), F.lit(False))
    return repos.where(F.coalesce(name != "", F.lit(False)) & ~placeholder & ~F.coalesce("archived", F.lit(False)) & ~F.coalesce("empty", F.lit(False)))


def latest_not_cached(releases: DataFrame, cached: DataFrame, repo: list[str], when: str, tag: str) -> DataFrame:
    """The newest release of each repository, where that tag isn't cached."""
    return updates_available(latest_release(releases, repo, when, tag), cached, [*repo, tag])


def alignment_sources(files: DataFrame, path: str) -> DataFrame:
    """(source_language, base_path): languages that have alignment files in a listing."""
    found = F.regexp_extract(F.replace(F.col(path), F.lit("\\"), F.lit("/")), r"(?i)^alignments/([^/]+)/.+\.alignment\.json$", 1)
    rows = files.select(found.alias("source_language")).where("source_language <> ''").distinct()
    return rows.withColumn("base_path", F.concat(F.lit("alignments/"), "source_language", F.lit("/")))


def first_path(files: DataFrame, language: str, order: str, path: str) -> DataFrame:
    """(language, path): the first path of each language in a listing."""
    return files.groupBy(language).agg(F.min_by(path, order).alias(path))


def pin(pins: DataFrame, releases: DataFrame, project: str, repo: str, when: str, tag: str) -> DataFrame:
    """(project, repo, pinned, available): pins with the newest cached release; a project's repository without a pin is pinned
    to it, one with another pin keeps that and is told what is available."""
    newest = latest_release(releases, [repo], when, tag).select(repo, F.col(tag).alias("__newest"))
    rows = pins.join(newest, repo, "left")
    other = F.when(F.col("pinned").isNotNull() & (F.col("pinned") != F.col("__newest")), F.col("__newest"))
    return rows.select(project, repo, F.coalesce("pinned", "__newest").alias("pinned"), other.alias("available"))


def upgrade(pins: DataFrame) -> DataFrame:
    """Pins moved to what is available."""
    return pins.withColumn("pinned", F.coalesce("available", "pinned")).withColumn("available", F.lit(None).cast(dict(pins.dtypes)["pinned"]))


def unpinned(cached: DataFrame, pins: DataFrame, repo: str, tag: str) -> DataFrame:
    """Cached releases that no pin holds, which may be cleared."""
    held = pins.where("pinned IS NOT NULL").select(repo, F.col("pinned").alias(tag)).distinct()
    return cached.join(held, [repo, tag], "left_anti")


#: Codes of the books of the Hebrew and of the Greek scriptures, in order.
OLD = "GEN EXO LEV NUM DEU JOS JDG RUT 1SA 2SA 1KI 2KI 1CH 2CH EZR NEH EST JOB PSA PRO ECC SNG ISA JER LAM EZK DAN HOS JOL AMO OBA JON MIC NAM HAB ZEP HAG ZEC MAL".split()
NEW = "MAT MRK LUK JHN ACT ROM 1CO 2CO GAL EPH PHP COL 1TH 2TH 1TI 2TI TIT PHM HEB JAS 1PE 2PE 1JN 2JN 3JN JUD REV".split()


def dim_book(spark: SparkSession) -> DataFrame:
    """(code, number, testament, source_language, resource): books and the language and text that they are translated from."""
    kinds = (("OT", OLD, "hbo", "uhb"), ("NT", NEW, "el-x-koine", "ugnt"))
    rows = [(code, k, name, lang, res) for name, codes, lang, res in kinds for k, code in enumerate(codes, 1 if name == "OT" else 1 + len(OLD))]
    return spark.createDataFrame(rows, "code string, number int, testament string, source_language string, resource string")


def with_book(rows: DataFrame, code: str) -> DataFrame:
    """``rows`` with testament, source_language and resource of their book code; nulls for books that are in neither."""
    books = F.broadcast(dim_book(rows.sparkSession).select(F.col("code").alias("__code"), "testament", "source_language", "resource"))
    return rows.join(books, F.upper(F.trim(code)) == F.col("__code"), "left").drop("__code")


def matching_books(books: DataFrame, query: str, code: str = "code", name: str = "name") -> DataFrame:
    """Books whose code or name holds what was typed; all for blanks."""
    q = query.strip().upper()
    return books.where(F.contains(F.upper(code), F.lit(q)) | F.contains(F.upper(name), F.lit(q))) if q else books


def repo_format(files: DataFrame, repo: str, path: str) -> DataFrame:
    """(repo, format) from the names in each repository's root."""
    has = lambda name: F.bool_or(F.col(path) == name)
    seen = files.groupBy(repo).agg(has("metadata.json").alias("b"), has("manifest.yaml").alias("c"), F.bool_or(F.lower(path).rlike(r"\.(usfm|sfm)$")).alias("u"))
    kind = F.when(F.col("b"), "scripture-burrito").when(F.col("c"), "resource-container").when(F.col("u"), "raw-usfm").otherwise("unknown")
    return seen.select(repo, kind.alias("format"))


def verify_bundle(manifest: DataFrame, files: DataFrame, path: str, content: str) -> DataFrame:
    """Listed files whose sha-256 isn't the manifest's; files that are listed and absent don't count."""
    rows = manifest.select(path, "sha256").join(files.select(path, F.sha2(F.col(content).cast("binary"), 256).alias("found")), path)
    return rows.where("sha256 <> found")


def text_path(path: Column) -> Column:
    """Whether a path is one of the kinds that merge as text."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin("usfm", "sfm", "md", "txt", "tsv", "json", "jsonl", "yaml", "yml", "csv", "xml")
