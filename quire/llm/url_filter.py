"""URL filtering by explicit rules and, where none fits, by empirical-Bayes host reputation.

Labelled page outcomes are counted by host. Bad shares are shrunk from the level above: a suffix towards
all pages, a registered domain towards its suffix, a host towards its domain. The strength of each prior
(the sum of a beta distribution's parameters) is fitted by moments over that level's counts. A host without labels
has its domain's share as its posterior mean, or else its suffix's, or that of all pages. A host is blocked where the
lower bound of its posterior bad share is above a limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.native_words import lower_ascii
from quire.llm.scratch import bounded, cut

#: (verdict, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Suffixes of more than one label under which names are registered; others are one label.
LONG_SUFFIXES = ("co.uk", "com.au", "co.jp", "com.br")
#: First labels of such suffixes under any two-letter country.
SECOND_LEVELS = ("ac", "co", "com", "edu", "go", "gob", "gov", "gouv", "mil", "ne", "net", "nom", "or", "org", "sch")
LEVELS = ("suffix", "domain", "host")


def host_of(url: Column) -> Column:
    """From the first :// to the next /, ? or #, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host to the next ? or #; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. Ties go to the rule given first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, name, prefix in sorted(reversed(rules), key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(prefix))
        rule = F.when(fits, F.lit(name + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(say)).otherwise(verdict)
    return rule, verdict


def domain_of(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host, its port aside; an IP address is both itself."""
    name = F.regexp_replace(host, r":\d*$", "")
    long = "|".join([*(s.replace(".", r"\.") for s in LONG_SUFFIXES), rf"(?:{'|'.join(SECOND_LEVELS)})\.[a-z][a-z]"])
    address = name.rlike(r"^\d+\.\d+\.\d+\.\d+$|^\[.*\]$")
    suffix = F.regexp_extract(name, rf"(?:^|\.)({long}|[^.]+)$", 1)
    domain = F.regexp_extract(name, rf"([^.]+\.(?:{long})|[^.]+\.[^.]+|[^.]+)$", 1)
    return F.when(address, name).otherwise(domain), F.when(address, name).otherwise(suffix)


def outcomes(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(page_id, bad) from labels keyed like pages: a page is bad if its quality is 0 or it is toxic; conflicts count as bad."""
    bad = F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0))
    return labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("page_id")).agg(bad.cast("long").alias("bad"))


def _strength() -> Column:
    """Moment fit of a beta-binomial's a + b from groups (n, bad) whose prior means are ``prior``; between 1 and 1000."""
    p = F.col("prior")
    n, spread = F.sum("n"), F.sum(F.pow(F.col("bad") - F.col("n") * p, 2) / F.greatest(p * (1 - p), F.lit(1e-9)))
    # E[(bad - n p)^2] = n p (1 - p) (1 + (n - 1) r) with r = 1 / (a + b + 1)
    pairs = F.sum(F.col("n") * (F.col("n") - 1))
    r = F.when(pairs > 0, (spread - n) / pairs)
    r = F.least(F.greatest(F.coalesce(r, F.lit(0.0)), F.lit(1 / 1001.0)), F.lit(0.5))
    return (1 / r - 1).cast("double")


def reputation(judged: DataFrame) -> DataFrame:
    """(host, n, mean, sd) from pages (host, bad): the posterior of each host's bad share. bad is null where a page isn't
    judged; a host without judged pages has n = 0, and no row where no page at all is judged.

    Tables below are one row per host at most; pages are counted by host before anything else. Groups without judged
    pages add nothing to the strengths. The empty host counts as a host.
    """
    domain, suffix = domain_of(F.col("host"))
    hosts = judged.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = cut(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad"), "url-hosts")
    bad, n = hosts.agg(F.sum("bad"), F.sum("n")).first()
    above, up = F.lit(((bad or 0) + 1) / ((n or 0) + 2)), None  # the share of all pages, then a table of the level above
    for level in LEVELS:
        counts = hosts.groupBy(level, *up or []).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        counts = counts.join(above, up) if up else counts.withColumn("prior", above)
        counts = cut(counts, "url-level")
        strength = counts.agg(_strength().alias("s")).first()["s"]
        total = F.col("n") + F.lit(strength)
        mean = (F.col("bad") + F.col("prior") * F.lit(strength)) / total
        above, up = counts.select(level, mean.alias("prior")), [level]
    return counts.where(F.lit(bool(n))).select("host", "n", mean.alias("mean"), F.sqrt(mean * (1 - mean) / (total + 1)).alias("sd"))


def filter_urls(pages: DataFrame, judged: DataFrame, url: str = "url", key: str = "page_id", rules=RULES, limit: float = 0.25, z: float = 1.645, into: str = "reputation") -> DataFrame:
    """``pages`` with a column ``into`` (one of that name is replaced), struct(host, path, rule, verdict, bad_bound).

    verdict is the longest fitting rule's; else block where mean - z * sd of the host's posterior is above ``limit``,
    and allow where it isn't or no page is judged. ``judged`` has (key, bad). Null urls have an empty host and path and
    are judged like the empty host.
    """
    named = pages.withColumns({"__host": host_of(F.col(url)), "__path": path_of(F.col(url))})
    outcome = judged.select(F.col("page_id").alias("__page"), "bad")
    known = named.select(key, F.col("__host").alias("host")).join(outcome, F.col(key) == F.col("__page"), "left").select("host", "bad")
    scores = bounded(cut(reputation(known), "url-reputation")).select(F.col("host").alias("__known"), (F.col("mean") - z * F.col("sd")).alias("__bound"))
    rows = named.join(scores, F.col("__host") == F.col("__known"), "left")
    rule, verdict = rule_columns(F.col("__host"), F.col("__path"), rules)
    learned = F.when(F.col("__bound") > limit, "block").otherwise("allow")
    made = F.struct(F.col("__host").alias("host"), F.col("__path").alias("path"), rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), F.col("__bound").alias("bad_bound"))
    return rows.withColumn(into, made).drop("__host", "__path", "__known", "__bound")


_STRENGTH = """(SELECT 1 / least(greatest(coalesce(CASE WHEN sum(n * (n - 1)) > 0 THEN (sum(pow(bad - n * prior, 2) / greatest(prior * (1 - prior), 1e-9)) - sum(n)) / sum(n * (n - 1)) END, 0), 1 / 1001.0::DOUBLE), 0.5::DOUBLE) - 1 FROM {0})"""
_LONG = "|".join([*(x.replace(".", r"\.") for x in LONG_SUFFIXES), rf"(?:{'|'.join(SECOND_LEVELS)})\.[a-z][a-z]"])
_COUNTS = "CAST(sum(n) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS bad"

ORACLE = rf"""
WITH o AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
k AS (SELECT host, regexp_replace(host, ':\d*$', '') AS name, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM p LEFT JOIN o USING (page_id) GROUP BY host),
a AS (SELECT *, regexp_matches(name, '^\d+\.\d+\.\d+\.\d+$|^\[.*\]$') AS address FROM k),
h AS (SELECT host, n, bad, CASE WHEN address THEN name ELSE regexp_extract(name, '([^.]+\.(?:{_LONG})|[^.]+\.[^.]+|[^.]+)$', 1) END AS domain,
             CASE WHEN address THEN name ELSE regexp_extract(name, '(?:^|\.)({_LONG}|[^.]+)$', 1) END AS suffix FROM a),
g AS (SELECT (coalesce(sum(bad), 0) + 1)::DOUBLE / (coalesce(sum(n), 0) + 2) AS prior FROM h),
s0 AS (SELECT suffix, {_COUNTS} FROM h GROUP BY suffix), s1 AS (SELECT *, (SELECT prior FROM g) AS prior FROM s0),
s2 AS (SELECT *, {_STRENGTH.format("s1")} AS st FROM s1), s3 AS (SELECT suffix, (bad + prior * st) / (n + st) AS prior FROM s2),
d0 AS (SELECT domain, suffix, {_COUNTS} FROM h GROUP BY domain, suffix), d1 AS (SELECT d0.*, s3.prior FROM d0 JOIN s3 USING (suffix)),
d2 AS (SELECT *, {_STRENGTH.format("d1")} AS st FROM d1), d3 AS (SELECT domain, (bad + prior * st) / (n + st) AS prior FROM d2),
h0 AS (SELECT host, domain, {_COUNTS} FROM h GROUP BY host, domain), h1 AS (SELECT h0.*, d3.prior FROM h0 JOIN d3 USING (domain)),
h2 AS (SELECT *, {_STRENGTH.format("h1")} AS st FROM h1), h3 AS (SELECT host, n + st AS total, (bad + prior * st) / (n + st) AS mean FROM h2),
b AS (SELECT host, CASE WHEN (SELECT sum(n) FROM h) > 0 THEN mean - 1.645 * sqrt(mean * (1 - mean) / (total + 1)) END AS bound FROM h3),
r AS (SELECT page_id, host, path, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bound > 0.25 THEN 'block' ELSE 'allow' END AS verdict
FROM r LEFT JOIN b USING (host)"""
