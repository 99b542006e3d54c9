"""Help rows (notes and word links) and the tokens of the verses they speak of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import help_text, title_from_path


def parse_reference(ref: Column) -> Column:
    """struct(kind, chapter, verse) of ``front:intro``, ``3:intro`` or ``3:16`` in any case; kind is null where it is none of them or a number is 0."""
    pattern = r"^\s*([^:\s]+):([^:\s]+)\s*$"
    left, right = (F.lower(F.regexp_extract(ref, pattern, k)) for k in (1, 2))
    chapter, verse = left.try_cast("int"), right.try_cast("int")
    kind = F.when((left == "front") & (right == "intro"), "book intro").when((chapter > 0) & (right == "intro"), "chapter intro").when((chapter > 0) & (verse > 0), "verse")
    return F.struct(kind.alias("kind"), F.when(kind != "book intro", chapter).alias("chapter"), F.when(kind == "verse", verse).alias("verse"))


def occurrence(value: Column) -> Column:
    """A row's occurrence: blank or not a number means 1; what is below 1 is looked up as 1."""
    return F.greatest(F.coalesce(F.trim(value).try_cast("int"), F.lit(1)), F.lit(1))


def rc_links(text: Column) -> Column:
    """All rc links of a text."""
    return F.regexp_extract_all(text, F.lit(r"(rc://[^\s)\]>\"']+)"), 1)


def parse_rc(link: Column) -> Column:
    """struct(language, resource, type, entry, title) of an rc link."""
    parts = F.split(F.regexp_replace(link, "^rc://", ""), "/")
    entry = F.array_join(F.slice(parts, 4, F.greatest(F.size(parts) - 3, F.lit(0))), "/")
    return F.struct(F.get(parts, F.lit(0)).alias("language"), F.get(parts, F.lit(1)).alias("resource"), F.get(parts, F.lit(2)).alias("type"), entry.alias("entry"), title_from_path(link).alias("title"))


def resolve_relative(base: Column, link: Column) -> Column:
    """A relative link against the folder of ``base``: each leading ../ climbs one level; the ending .md goes."""
    ups = F.floor(F.length(F.regexp_extract(link, r"^((?:\.\./)*)", 1)) / 3).cast("int")
    folder = F.split(F.regexp_replace(base, r"/?[^/]*$", ""), "/")
    kept = F.slice(folder, 1, F.greatest(F.size(folder) - ups, F.lit(0)))
    rest = F.regexp_replace(F.regexp_replace(link, r"^(\.\./|\./)*", ""), r"\.md$", "")
    return F.concat_ws("/", F.array_join(kept, "/"), rest)


def support_link(ref: Column) -> Column:
    """struct(type, id, title) of a support reference: a word article, a guide article, or something else."""
    tw = F.regexp_extract(ref, r"/tw/dict/bible/(.+)$", 1)
    ta = F.regexp_extract(ref, r"/ta/man/(.+)$", 1)
    kind = F.when(tw != "", "tw").when(ta != "", "ta").when(F.trim(ref) != "", "custom")
    return F.struct(kind.alias("type"), F.when(tw != "", tw).when(ta != "", ta).otherwise(ref).alias("id"), title_from_path(ref).alias("title"))


def token_spans(tokens: DataFrame, key: list[str], order: str, word: str) -> DataFrame:
    """Adds start and end of each token in the text of its key's tokens joined by single spaces."""
    w = W.partitionBy(*key).orderBy(order)
    size = F.length(word)
    end = F.sum(size + 1).over(w.rowsBetween(W.unboundedPreceding, 0)) - 1
    return tokens.withColumn("end", end).withColumn("start", F.col("end") - size)


def match_quotes(quotes: DataFrame, tokens: DataFrame, key: list[str], order: str) -> DataFrame:
    """Quotes (key, ..., q_start, q_end) joined with the tokens (key, order, start, end) whose characters they share."""
    return quotes.join(tokens, key).where("end > q_start AND start < q_end")


def first_choice(main: DataFrame, fallback: DataFrame, key: list[str]) -> DataFrame:
    """All rows of ``main``, and those of ``fallback`` whose key has none there."""
    return main.unionByName(fallback.join(main.select(*key).distinct(), key, "left_anti"))


def annotations_by_token(matches: DataFrame, key: list[str], order: str, ident: str) -> DataFrame:
    """(key, token, entries): the ids of the helps on each token, in order."""
    return matches.groupBy(*key, order).agg(F.array_sort(F.collect_set(ident)).alias("entries"))


def match_by_alignment(helps_: DataFrame, sources: DataFrame, targets: DataFrame, tokens: DataFrame, key: list[str]) -> DataFrame:
    """(key, id, place): tokens of the translation that are aligned to the words of each help row's original quote.

    helps_: (key, id, quote, occurrence); sources: (key, flat, group, norm, occurrence), the source words of a verse's groups
    in order; targets: (key, group, norm, occurrence); tokens: (key, place, norm), in order. norm is ``text.help_text``, which
    quotes are brought to as well. A quote's parts between & are looked for each by itself as words in order, gaps allowed; of the first part the row's
    occurrence counts, of others the first. All parts have to be found. Every group with a source word of the same form
    and occurrence as a matched one adds its targets, each the token of that form and occurrence.
    """
    part = helps_.select(*key, "id", "occurrence", F.posexplode(F.filter(F.transform(F.split(help_text(F.col("quote")), "&"), lambda p: help_words(p)), lambda p: F.size(p) > 0)).alias("part", "words"))
    parts_of = part.groupBy(*key, "id").agg(F.count("*").alias("__parts"))
    # a chain from each place of the first word: the next word is the nearest that follows
    first = sources.select(*key, F.col("flat").alias("start"), F.col("norm").alias("__norm"))
    verse = sources.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("flat", "norm", "occurrence"))).alias("flat"))
    hits = part.join(first, [part[k] == first[k] for k in key] + [F.get("words", F.lit(0)) == F.col("__norm")]).select(*[part[k] for k in key], "id", "occurrence", "part", "words", "start")
    step = lambda s, w: F.when(F.size(s) == 0, F.array(F.col("__at"))).otherwise(F.concat(s, F.array(_next(F.col("flat"), F.element_at(s, -1), w))))
    chains = hits.join(verse, key).withColumn("__at", F.col("start")).withColumn("chain", F.aggregate("words", F.array().cast("array<int>"), step))
    whole = chains.where(F.forall("chain", lambda x: x >= 0))
    rank = F.row_number().over(W.partitionBy(*key, "id", "part").orderBy("start"))
    wanted = F.when(F.col("part") == 0, F.greatest(F.coalesce("occurrence", F.lit(1)), F.lit(1))).otherwise(1)
    chosen = whole.withColumn("__k", rank).where(F.col("__k") == wanted)
    complete = chosen.groupBy(*key, "id").agg(F.count("*").alias("__found")).join(parts_of, [*key, "id"]).where("__found = __parts").select(*key, "id")
    words = chosen.join(complete, [*key, "id"]).select(*key, "id", F.explode("chain").alias("flat"))
    said = words.join(sources.select(*key, "flat", "norm", "occurrence"), [*key, "flat"]).select(*key, "id", "norm", "occurrence").distinct()
    groups = said.join(sources.select(*key, "norm", "occurrence", "group"), [*key, "norm", "occurrence"]).select(*key, "id", "group").distinct()
    aligned = groups.join(targets, [*key, "group"]).select(*key, "id", "norm", "occurrence")
    placed = tokens.withColumn("occurrence", F.row_number().over(W.partitionBy(*key, "norm").orderBy("place")))
    return aligned.join(placed, [*key, "norm", "occurrence"]).select(*key, "id", "place").distinct()


def help_words(part: Column) -> Column:
    """Normal forms of the words of a part of a quote."""
    bare = F.transform(F.split(part, r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}]+$", ""))
    return F.filter(bare, lambda w: w != "")


def _next(flat: Column, after: Column, word: Column) -> Column:
    """The first place behind ``after`` whose form is ``word``; -1 if there is none, or ``after`` is -1."""
    found = F.get(F.filter(flat, lambda x: (x["flat"] > after) & (x["norm"] == word)), F.lit(0))["flat"]
    return F.when(after < 0, -1).otherwise(F.coalesce(found, F.lit(-1))).cast("int")
