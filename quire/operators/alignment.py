"""Words of a translation and the source words they are aligned to."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import collapse, first_int, strip_edges
from quire.operators.windows import depth

GROUP = "array<struct<sources: array<struct<strong: string, lemma: string, content: string, occurrence: int, occurrences: int>>, targets: array<struct<word: string, occurrence: int, occurrences: int>>>>"


def strip_alignment(node: DataFrame, key: str) -> DataFrame:
    """(key, sid, group, role, pos, word, occurrence, occurrences, strong, lemma): sources and targets of each group.

    A group is what lies between an alignment milestone's start at depth 0 and its end back at 0, within a paragraph;
    groups that never close are left out.
    """
    start, end = (F.col("marker") == "zaln-s") & ~F.col("closing"), (F.col("marker") == "zaln-e") & ~F.col("closing")
    rows = depth(node, [key, "para"], ["pos"], F.when(start, 1).when(end, -1).otherwise(0), "__level")
    w = W.partitionBy(key, "para").orderBy("pos")
    fresh = start & (F.col("__level") == 1)
    rows = rows.withColumn("__group", F.sum(fresh.cast("int")).over(w))
    whole = F.max((end & (F.col("__level") == 0)).cast("int")).over(W.partitionBy(key, "para", "__group"))
    rows = rows.withColumn("__closed", whole).where("__closed = 1")
    target = (F.col("marker") == "w") & ~F.col("closing") & (F.col("__level") > 0)
    number = lambda name: first_int(F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit("")))
    attr = lambda name: F.try_element_at("attrs", F.lit(name))
    rows = rows.withColumn("role", F.when(start, "source").when(target, "target")).where("role IS NOT NULL")
    rows = rows.withColumn("group", F.dense_rank().over(W.partitionBy(key, "sid").orderBy("para", "__group")) - 1)
    word = F.when(start, attr("x-content")).otherwise(collapse(F.col("text")))
    return rows.select(key, "sid", "group", "role", "pos", word.alias("word"), number("x-occurrence").alias("occurrence"), number("x-occurrences").alias("occurrences"), attr("x-strong").alias("strong"), attr("x-lemma").alias("lemma"))


def numbered(tokens: DataFrame, key: list[str], word: str, order: str) -> DataFrame:
    """Adds norm and slot: the n-th of its normal form within its key."""
    rows = tokens.withColumn("norm", strip_edges(F.col(word)))
    return rows.withColumn("slot", F.row_number().over(W.partitionBy(*key, "norm").orderBy(order)))


def resolve_targets(targets: DataFrame, tokens: DataFrame, key: list[str], word: str, order: str) -> DataFrame:
    """Targets (key, word, occurrence) with the place of the token each stands for, null where there is none."""
    slots = numbered(tokens, key, word, order).select(*key, F.col("norm").alias("__norm"), F.col("slot").alias("__slot"), F.col(order).alias("place"))
    t = targets.withColumn("__n", strip_edges(F.col("word")))
    on = [t[k] == slots[k] for k in key] + [t["__n"] == slots["__norm"], t["occurrence"] == slots["__slot"]]
    joined = t.join(slots, on, "left")
    return joined.select(*[t[c] for c in targets.columns], "place")


def progress(covered: Column, total: Column) -> Column:
    """Whole percent, at most 100; 0 without anything to cover."""
    return F.when(total == 0, 0).otherwise(F.least(F.floor(covered * 100 / total + 0.5), F.lit(100))).cast("long")


def confidence(matched: Column, total: Column) -> Column:
    """Tier of a match ratio: exact (also without anything to match), high (0.9 on), partial (0.5 on), or none."""
    ratio = F.when(total == 0, 1.0).otherwise(matched / total)
    return F.when(ratio >= 1, "exact").when(ratio >= 0.9, "high").when(ratio >= 0.5, "partial").otherwise("none")


def verse_key(sid: Column) -> Column:
    """A verse id for comparison: no-break spaces as spaces, runs as one, in upper case."""
    return F.upper(F.trim(F.regexp_replace(F.replace(sid, F.lit("\u00a0"), F.lit(" ")), r"\s+", " ")))


def resolve_verses(wanted: DataFrame, have: DataFrame, sid: str) -> DataFrame:
    """(sid, found): for each verse id of ``wanted`` that of ``have`` it stands for: the same, else the smallest with the same
    ``verse_key``, else the only one with the same chapter and verse; null if none."""
    end = r"(\d+:\d+)\s*$"
    ids = have.select(F.col(sid).alias("h")).distinct()
    by_key = ids.groupBy(verse_key(F.col("h")).alias("k")).agg(F.min("h").alias("h_key"))
    by_end = ids.groupBy(F.nullif(F.regexp_extract("h", end, 1), F.lit("")).alias("e")).agg(F.min("h").alias("h_end"), F.count("*").alias("n")).where("e IS NOT NULL AND n = 1")
    w = wanted.select(sid).distinct().withColumns({"k": verse_key(F.col(sid)), "e": F.nullif(F.regexp_extract(sid, end, 1), F.lit(""))})
    rows = w.join(ids, F.col(sid) == F.col("h"), "left").join(by_key, "k", "left").join(by_end, "e", "left")
    return rows.select(sid, F.coalesce("h", "h_key", "h_end").alias("found"))


def source_report(sources: DataFrame, tokens: DataFrame, sid: str = "sid") -> tuple[DataFrame, DataFrame]:
    """How the source words of alignments (sid, strong, lemma, content, occurrence) match a loaded original (sid, strong, lemma,
    surface, occurrence): (sid, found, words, matched, reason) for each verse, and one row (confidence, match_ratio,
    verses_compared, verses_matched).

    A word matches a token of its verse with the same Strong's number, or the same lemma and occurrence, or the same form
    (edge punctuation aside) and occurrence, or without Strong's numbers the same lemma and form; case is ignored in the first
    two and in lemmas.
    """
    bare = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    own = sources.withColumns({"__s": bare("strong"), "__l": bare("lemma"), "__f": strip_edges(F.trim("content"))})
    own = own.join(resolve_verses(sources, tokens, sid), sid)
    tok = tokens.select(F.col(sid).alias("found"), bare("strong").alias("__s"), bare("lemma").alias("__l"), strip_edges(F.trim("surface")).alias("__f"), "occurrence")
    # in this order each key is dropped after its last use
    ways = ((["__s", "__l", "__f"], "__s = '' AND __l <> ''"), (["__s"], "__s <> ''"), (["__l", "occurrence"], "__l <> ''"), (["__f", "occurrence"], "__f <> ''"))
    # words and tokens of a verse stand together once; a verse that isn't found is one for itself
    names = ["__s", "__l", "__f", "occurrence"]
    words = own.select(sid, F.coalesce("found", sid).alias("__verse"), F.col("found").isNotNull().alias("__known"), *names, F.lit(False).alias("__there"))
    there = tok.where("found IS NOT NULL").select(F.lit(None).cast(dict(own.dtypes)[sid]).alias(sid), F.col("found").alias("__verse"), F.lit(True).alias("__known"), *names, F.lit(True).alias("__there"))
    rows = words.unionByName(there).repartition("__verse")
    hit = F.lit(False)
    for n, (on, when) in enumerate(ways):
        fits = F.coalesce(F.expr(" AND ".join([f"({when})", "__known", *[f"{c} IS NOT NULL" for c in on]])), F.lit(False))
        rows = rows.withColumn(f"__w{n}", fits & F.max("__there").over(W.partitionBy("__verse", *on))).drop(*[c for c in on if not any(c in later for later, _ in ways[n + 1 :])])
        hit = hit | F.col(f"__w{n}")
    verses = rows.where("NOT __there").groupBy("__verse", sid, F.when(F.col("__known"), F.col("__verse")).alias("found")).agg(F.count("*").alias("words"), F.count_if(hit).alias("matched")).drop("__verse")
    missing = (F.col("words") - F.col("matched")).cast("string")
    reason = F.when(F.col("found").isNull(), "the source has no such verse").when(F.col("matched") < F.col("words"), F.concat(missing, F.lit(" words of the source have no match")))
    verses = verses.withColumn("reason", reason)
    total = verses.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("w"), F.coalesce(F.sum("matched"), F.lit(0)).alias("m"), F.count("*").alias("verses_compared"), F.count_if(F.col("found").isNotNull() & (F.col("matched") == F.col("words"))).alias("verses_matched"))
    ratio = F.when(F.col("w") == 0, 1.0).otherwise(F.col("m") / F.col("w")).alias("match_ratio")
    return verses, total.select(confidence(F.col("m"), F.col("w")).alias("confidence"), ratio, "verses_compared", "verses_matched")


def source_reference(remark: Column) -> Column:
    """struct(identifier, version) of a remark ``alignment-source: name v1``; nulls where it is none."""
    rest = F.trim(F.regexp_extract(F.trim(remark), r"(?is)^alignment-source:\s*(.*)$", 1))
    version = F.nullif(F.regexp_extract(rest, r"(?i)\bv(\d+|[\w.-]+)\s*$", 1), F.lit(""))
    name = F.nullif(collapse(F.regexp_replace(rest, r"(?i)\bv(\d+|[\w.-]+)\s*$", "")), F.lit(""))
    return F.struct(name.alias("identifier"), F.when(name.isNotNull(), version).alias("version"))


def document_source(node: DataFrame, key: str) -> DataFrame:
    """(key, identifier, version): what each document's last remark about its alignment source says."""
    rows = node.where("marker = 'rem' AND NOT closing").select(key, "pos", source_reference(F.col("text")).alias("s")).where("s.identifier IS NOT NULL")
    return rows.groupBy(key).agg(F.max_by("s", "pos").alias("s")).select(key, "s.identifier", "s.version")


def original_tokens(node: DataFrame, key: str) -> DataFrame:
    """(key, sid, place, surface, strong, lemma, morph, occurrence, occurrences): the marked words of an original text in order."""
    attr = lambda *names: F.coalesce(*[F.try_element_at("attrs", F.lit(n)) for n in names], F.lit(""))
    rows = node.where("marker = 'w' AND NOT closing AND sid IS NOT NULL").select(key, "sid", "pos", collapse(F.col("text")).alias("surface"), attr("strong", "x-strong").alias("strong"), attr("lemma", "x-lemma").alias("lemma"), attr("x-morph", "morph").alias("morph"))
    verse, same = W.partitionBy(key, "sid").orderBy("pos"), W.partitionBy(key, "sid", "surface")
    return rows.select(key, "sid", (F.row_number().over(verse) - 1).alias("place"), "surface", "strong", "lemma", "morph", F.row_number().over(same.orderBy("pos")).alias("occurrence"), F.count("*").over(same).alias("occurrences"))


def source_remark(identifier: Column, version: Column) -> Column:
    """The remark that ``source_reference`` reads."""
    return F.concat(F.lit("alignment-source: "), identifier, F.when(version.isNotNull(), F.concat(F.lit(" v"), version)).otherwise(""))


def compatible_source(wanted: Column, loaded: Column) -> Column:
    """Whether two source names agree: equal or one within the other, case and spaces aside."""
    a, b = F.lower(collapse(wanted)), F.lower(collapse(loaded))
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def merge_groups(groups: DataFrame, key: list[str], into: DataFrame) -> DataFrame:
    """Alignment rows (key, group, role, ...) with groups of ``into`` (key, group, target_group) made part of another."""
    return groups.join(into, [*key, "group"], "left").withColumn("group", F.coalesce("target_group", "group")).drop("target_group")


def split_groups(groups: DataFrame, key: list[str], out: DataFrame) -> DataFrame:
    """Rows (key, group, role, pos, ...) with the targets of ``out`` (key, group, pos) taken into groups of their own, numbered
    after the verse's last; the sources stay."""
    picked = out.select(*key, "group", "pos").distinct().withColumn("__out", F.lit(True))
    rows = groups.join(picked, [*key, "group", "pos"], "left").withColumn("__out", F.coalesce("__out", F.lit(False)) & (F.col("role") == "target"))
    last = F.max("group").over(W.partitionBy(*key))
    nth = F.sum(F.col("__out").cast("int")).over(W.partitionBy(*key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("group", F.when(F.col("__out"), last + nth).otherwise(F.col("group")).cast("long")).drop("__out")


def remove_groups(groups: DataFrame, key: list[str], gone: DataFrame) -> DataFrame:
    """Alignment rows without the groups of ``gone`` (key, group): their words are unaligned again."""
    return groups.join(gone.select(*key, "group").distinct(), [*key, "group"], "left_anti")


def reconcile(groups: DataFrame, kept: DataFrame, old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Targets (key, group, target, word, occurrence) after their verse was edited: those whose word stayed, as the new text
    counts it; groups that lose all targets go.

    old and new: the words (key, place, word) of both texts; kept: (key, old, new), the places of words that stayed. A target
    is the old word of its form (edge punctuation aside) and occurrence.
    """
    placed = resolve_targets(groups.select(*key, "group", "target", "word", "occurrence"), old, key, "word", "place").where("place IS NOT NULL")
    counted = numbered(new, key, "word", "place").select(*key, F.col("place").alias("new"), F.col("word").alias("__word"), F.col("slot").alias("__slot"), F.count("*").over(W.partitionBy(*key, "norm")).alias("occurrences"))
    moved = placed.withColumnRenamed("place", "old").join(kept, [*key, "old"]).join(counted, [*key, "new"])
    return moved.select(*key, "group", "target", F.col("__word").alias("word"), F.col("__slot").alias("occurrence"), "occurrences")


def kept_words(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """``pairs`` with kept array<struct<old, new>>: places of a longest common subsequence of two word arrays.

    Ties move on in the old text first. Work is the product of the two lengths, memory their sum (Hirschberg's halving).
    """
    schema = "array<struct<old: int, new: int>>"

    @F.pandas_udf(schema)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for olds, news in batches:
            yield pd.Series([[{"old": i, "new": j} for i, j in lcs(a, b)] for a, b in zip(olds, news, strict=True)])

    return pairs.withColumn("kept", run(F.col(old), F.col(new)))


def _ends(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of all of ``a`` and each tail of ``b``."""
    best = np.zeros(len(b) + 1, np.int32)
    for x in a[::-1]:
        hit = np.where(b == x, best[1:] + 1, best[:-1])
        best[:-1] = np.maximum.accumulate(hit[::-1])[::-1]
    return best


def lcs(a, b) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, each word of ``a`` at the first place of ``b`` that allows one."""
    a, b = ([] if x is None else list(x) for x in (a, b))
    number = {w: k for k, w in enumerate({*a, *b})}
    a, b = (np.array([number[w] for w in x], np.int64) for x in (a, b))
    out: list[tuple[int, int]] = []
    parts = [(0, len(a), 0, len(b))]
    while parts:
        i, j, x, y = parts.pop()
        if j - i == 1:
            at = np.flatnonzero(b[x:y] == a[i])
            if len(at):
                out.append((i, x + int(at[0])))
        elif j > i and y > x:
            half = (i + j) // 2
            tails = _ends(a[half:j], b[x:y])
            heads = _ends(a[i:half][::-1], b[x:y][::-1])[::-1]
            cut = x + int(np.argmax(heads + tails))
            parts += [(half, j, cut, y), (i, half, x, cut)]
    return out


def groups_json(rows: DataFrame, text: str) -> DataFrame:
    """Alignment groups from JSON text as one row a group (sid, group, sources, targets); groups without sources or targets are dropped."""
    parsed = F.from_json(F.col(text), f"format string, version string, verses map<string, {GROUP}>")
    # the condition stands in the explosion: as a filter it would have each text parsed once more
    good = F.expr("CASE WHEN d.format = 'usfm-alignment' AND d.version LIKE '1.%' THEN d.verses END")
    verse = rows.select(parsed.alias("d")).select(F.explode(good).alias("sid", "groups")).select("sid", F.posexplode("groups").alias("group", "g"))
    return verse.where("size(g.sources) > 0 AND size(g.targets) > 0").select("sid", "group", "g.sources", "g.targets")


def alignment_state(rows: DataFrame, key: str, marked: Column, sourced: Column) -> DataFrame:
    """(key, state): from a document's nodes, by whether any is an alignment milestone (``marked``) and any says what it is aligned to
    (``sourced``): aligned with both, has-markers-no-provenance with milestones alone, else unaligned."""
    found = rows.groupBy(key).agg(F.bool_or(marked).alias("m"), F.bool_or(sourced).alias("s"))
    state = F.when(F.col("m") & F.col("s"), "aligned").when(F.col("m"), "has-markers-no-provenance").otherwise("unaligned")
    return found.select(key, state.alias("state"))


def emit_alignment(tokens: DataFrame, targets: DataFrame, key: list[str], order: str, word: str) -> DataFrame:
    """(key, text, rebuilt): verses with their alignment milestones put back.

    ``targets`` are (key, group, milestone, word, occurrence); each run of neighbouring places of a group is wrapped in its
    own milestone. A verse with a target that has no token, or two targets on one token, stays plain (rebuilt is false).
    """
    placed = resolve_targets(targets, tokens, key, word, order)
    clash = placed.groupBy(*key, "place").agg(F.count("*").alias("n")).groupBy(*key).agg(F.bool_or((F.col("n") > 1) | F.col("place").isNull()).alias("__bad"))
    w = W.partitionBy(*key, "group").orderBy("place")
    runs = placed.where("place IS NOT NULL").withColumns({"first": F.coalesce(F.lag("place").over(w) != F.col("place") - 1, F.lit(True)), "last": F.coalesce(F.lead("place").over(w) != F.col("place") + 1, F.lit(True))})
    runs = runs.select(*key, F.col("place").alias(order), "first", "last", "milestone")
    rows = tokens.join(runs, [*key, order], "left").join(clash, key, "left")
    on = ~F.coalesce("__bad", F.lit(False))
    piece = F.concat(F.when(on & F.col("first"), F.concat(F.lit("\\zaln-s |"), "milestone", F.lit("\\*"))).otherwise(""), F.when(on & F.col("milestone").isNotNull(), F.concat(F.lit("\\w "), word, F.lit("\\w*"))).otherwise(F.col(word)), F.when(on & F.col("last"), "\\zaln-e\\*").otherwise(""))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order), piece.alias("t"))))
    return rows.groupBy(*key).agg(F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias("text"), F.bool_and(on).alias("rebuilt"))


def emit_groups(tokens: DataFrame, sources: DataFrame, targets: DataFrame, key: list[str], order: str, word: str) -> DataFrame:
    """(key, text, rebuilt): verses with their alignment groups put back, nested where they lie in each other.

    tokens: (key, order, word), words as they stand, with punctuation; sources: (key, group, n, attrs), a milestone for each in order
    of n; targets: (key, group, word, occurrence, occurrences). A group reaches from its first target to its last and stays open
    over words of others between them. Of groups that begin together the longest opens first, of those that end together the
    shortest closes first. Words that are targets carry their occurrences; what stands around a word's letters stays outside.

    A verse stays plain (rebuilt is false) where a target has no token, two targets claim one token, a group has no source, or two groups
    cross: the ends of milestones don't name their group, so a crossing one would be read back as another. Crossings show in
    the levels of the ends: in the order of all beginnings and ends the next event of a group's level has to be its own end.
    """
    placed = resolve_targets(targets, tokens, key, word, order)
    groups = placed.groupBy(*key, "group").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.bool_or(F.col("place").isNull()).alias("lost"))
    marks = F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat(F.lit("x-"), e["key"], F.lit('="'), e["value"], F.lit('"')))
    one = F.concat(F.lit("\\zaln-s |"), F.array_join(marks, " "), F.lit("\\*"))
    opened = sources.groupBy(*key, "group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", one.alias("t")))), lambda x: x["t"]), "").alias("opening"), F.count("*").alias("n"))
    groups = groups.join(opened, [*key, "group"], "left").withColumn("span", F.col("last") - F.col("first"))
    twice = placed.groupBy(*key, "place").agg((F.count("*") > 1).alias("twice")).groupBy(*key).agg(F.bool_or("twice").alias("twice"))
    event = lambda place, phase, near: F.struct(place.alias("place"), F.lit(phase).alias("phase"), near.alias("near"), F.when(F.lit(phase == 0), F.col("group")).otherwise(-F.col("group")).alias("tie"))
    events = groups.where("NOT lost").select(*key, "group", F.explode(F.array(event(F.col("first"), 0, -F.col("span")), event(F.col("last"), 1, F.col("span")))).alias("e"))
    in_order = W.partitionBy(*key).orderBy("e")
    step = F.when(F.col("e.phase") == 0, 1).otherwise(-1)
    level = F.sum(step).over(in_order.rowsBetween(W.unboundedPreceding, 0)) + (F.col("e.phase") == 1).cast("int")
    own = F.lead("group").over(W.partitionBy(*key, "level").orderBy("e")) == F.col("group")
    crossed = events.withColumn("level", level).withColumn("own", own).where("e.phase = 0").groupBy(*key).agg(F.bool_or(~F.coalesce("own", F.lit(False))).alias("crossed"))
    odd = groups.groupBy(*key).agg(F.bool_or(F.col("lost") | F.col("n").isNull()).alias("lost"))
    bad = odd.join(twice, key, "left").join(crossed, key, "left").select(*key, (F.col("lost") | F.coalesce("twice", F.lit(False)) | F.coalesce("crossed", F.lit(False))).alias("__bad"))
    starts = groups.groupBy(*key, F.col("first").alias(order)).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("span")).alias("s"), "group", "opening"))), lambda x: x["opening"]), "").alias("__start"))
    stops = groups.groupBy(*key, F.col("last").alias(order)).agg(F.sum("n").cast("int").alias("__stop"))
    held = placed.where("place IS NOT NULL").select(*key, F.col("place").alias(order), F.col("occurrence").alias("__o"), F.col("occurrences").alias("__of")).dropDuplicates([*key, order])
    rows = tokens.join(held, [*key, order], "left").join(starts, [*key, order], "left").join(stops, [*key, order], "left").join(bad, key, "left")
    on = ~F.coalesce("__bad", F.lit(False))
    core = strip_edges(F.col(word))
    at = F.call_function("locate", core, F.col(word))
    marked = F.concat(F.substr(word, F.lit(1), at - 1), F.lit("\\w "), core, F.lit('|x-occurrence="'), F.col("__o").cast("string"), F.lit('" x-occurrences="'), F.col("__of").cast("string"), F.lit('"\\w*'), F.substr(word, at + F.length(core), F.length(word)))
    piece = F.concat(F.when(on, F.coalesce("__start", F.lit(""))).otherwise(""), F.when(on & F.col("__o").isNotNull(), marked).otherwise(F.col(word)), F.when(on, F.repeat(F.lit("\\zaln-e\\*"), F.coalesce("__stop", F.lit(0)))).otherwise(""))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order), piece.alias("t"))))
    return rows.groupBy(*key).agg(F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias("text"), F.bool_and(on).alias("rebuilt"))
