"""Text functions as column expressions: they stay inside the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once even where body uses it for every item of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokenize(text: Column) -> Column:
    """Words between runs of white space, in order, without empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def strip_edges(word: Column) -> Column:
    """A word without punctuation at either end: letters, numbers and apostrophes stay."""
    return F.regexp_replace(word, r"^[^\p{L}\p{N}'’]+|[^\p{L}\p{N}'’]+$", "")


def same_word(a: Column, b: Column) -> Column:
    """Equal apart from punctuation at the edges."""
    return strip_edges(a) == strip_edges(b)


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_spaces(text: Column, mode: str) -> Column:
    """White space by mode: preserve, normalize (runs become one space), trim-edges, or both."""
    if mode == "preserve":
        return text
    if mode == "trim-edges":
        return F.regexp_replace(text, r"^\s+|\s+$", "")
    return collapse(text) if mode == "both" else F.regexp_replace(text, r"\s+", " ")


def escape_xml(text: Column) -> Column:
    """Text for XML: the five reserved characters and the no-break space as entities."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for char, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), (" ", "&#160;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def unescape_xml(text: Column) -> Column:
    """Text of XML: the five named entities and characters by their numbers, decimal or hexadecimal; others stay as they are."""
    parts = F.split(F.regexp_replace(text, r"&#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});", "\u0001&#$1\u0001"), "\u0001")
    number = lambda x: F.when(F.lower(F.substr(x, F.lit(3), F.lit(1))) == "x", F.conv(F.substring(x, 4, 6), 16, 10)).otherwise(F.substring(x, 3, 7)).try_cast("int")
    char = lambda x: F.decode(F.unhex(F.lpad(F.hex(number(x)), 8, "0")), "UTF-32")
    out = F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^&#([0-9]+|[xX][0-9a-fA-F]+)$"), char(x)).otherwise(x)), "")
    out = F.when(F.contains(text, F.lit("&#")), out).otherwise(text)
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return out


def escape_tsv(field: Column) -> Column:
    """A field for a tab-separated file: quoted, with doubled quotes, if it holds a tab, a quote or a line end."""
    quoted = F.concat(F.lit('"'), F.replace(field, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(field.rlike('[\t"\n\r]'), quoted).otherwise(field)


def nth_place(text: Column, part: Column, n: int) -> Column:
    """Zero-based place of the n-th occurrence of ``part`` (occurrences may overlap), or -1."""
    step = lambda p, _: F.coalesce(F.nullif(F.call_function("locate", part, text, p + 1), F.lit(0)), F.lit(-1))
    place = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), step)
    return F.when(place > 0, place - 1).otherwise(-1).cast("long")


def positional_similarity(a: Column, b: Column) -> Column:
    """Share of places with the same character, of the longer text; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when((x == y) & (x != ""), 1).otherwise(0))
    return F.when(longest == 0, 1.0).otherwise(F.aggregate(same, F.lit(0), lambda s, x: s + x) / longest)


#: Letters, numbers and marks of the basic plane.
_WORD = r"[\p{L}\p{N}\p{M}&&[^\x{10000}-\x{10FFFF}]]"
_LETTER = r"[\p{L}&&[^\x{10000}-\x{10FFFF}]]"


def needs_space(left: Column, right: Column) -> Column:
    """Whether two fragments of running text would be glued without a space: where both sides are letters, numbers or marks, a
    closing bracket or quote stands before one of these or an opening one after, or a letter follows . ! ? : ; or a comma."""
    a, b = F.right(left, F.lit(1)), F.left(right, F.lit(1))
    before, after = a.rlike(_WORD), b.rlike(_WORD)
    glued = (before & after) | (a.rlike("[)\\]}\"'»]") & after) | (before & b.rlike("[(\\[{\"'«„]")) | (a.rlike("[.!?:;,]") & b.rlike(_LETTER))
    return (left != "") & (right != "") & glued


def join_fragments(parts: Column) -> Column:
    """Fragments as running text with ``needs_space``."""
    return F.aggregate(parts, F.lit(""), lambda s, x: F.concat(s, F.when(needs_space(s, x), " ").otherwise(""), x))


def git_blob_id(content: Column) -> Column:
    """The id that git gives a file with this content."""
    data = F.encode(content, "UTF-8")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8"), F.unhex(F.lit("00")), data))


def strip_tags(xml: Column) -> Column:
    """Each tag as a space; an unclosed < stays."""
    return F.regexp_replace(xml, "<[^>]*>", " ")


def tag_names(xml: Column) -> Column:
    """Names of all opening tags, in order."""
    return F.regexp_extract_all(xml, F.lit(r"<([A-Za-z][\w:.-]*)"), 1)


def repo_name(language: Column, ident: Column) -> Column:
    """The name suggested for a repository: language and id in lower case, other characters as dashes, runs of dashes as one."""
    dashed = lambda x, keep: F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), f"[^{keep}]", "-"), "-+", "-")
    return F.regexp_replace(F.concat(dashed(language, "a-z0-9.-"), F.lit("_"), dashed(ident, "a-z0-9._-")), "-+", "-")


def branch_name(book: Column, user: Column | None = None) -> Column:
    """The branch on which a book is gathered, or a user's own for it: names in lower case, other characters as dashes."""
    safe = lambda x: F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9._-]", "-")
    return safe(book) if user is None else F.concat(safe(user), F.lit("/"), safe(book))


#: Milliseconds before a sync is tried again, by failures so far; the last one holds for all further ones.
RETRY_DELAYS = (30_000, 120_000, 600_000, 1_800_000, 7_200_000)
#: The first wait of a download in milliseconds, which doubles with each failure up to the longest.
FIRST_WAIT, LONGEST_WAIT = 2_000, 60_000


def retry_delay(failures: Column) -> Column:
    """Milliseconds before a sync is tried again after so many failures, from 0."""
    return F.element_at(F.array(*map(F.lit, RETRY_DELAYS)), F.least(F.greatest(failures, F.lit(0)), F.lit(len(RETRY_DELAYS) - 1)).cast("int") + 1).cast("long")


def download_wait(failures: Column) -> Column:
    """Milliseconds before a download is tried again after so many failures."""
    return F.least(F.lit(FIRST_WAIT) * F.pow(F.lit(2), F.least(failures, F.lit(30))), F.lit(LONGEST_WAIT)).cast("long")


def title_from_path(path: Column) -> Column:
    """The last segment of a link without its extension, its dash-separated words capitalised."""
    last = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md$", "")
    return F.array_join(F.transform(F.split(last, "-"), lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2)))), " ")


def hash31(text: Column) -> Column:
    """A 32-bit polynomial hash with multiplier 31 over UTF-16 units, as an unsigned number."""
    raw = F.hex(F.encode(text, "UTF-16BE"))
    units = F.transform(F.sequence(F.lit(0), (F.length(raw) / 4).cast("int")), lambda i: F.conv(F.substr(raw, (4 * i + 1).cast("int"), F.lit(4)), 16, 10).cast("long"))
    return F.aggregate(F.filter(units, lambda c: c.isNotNull()), F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % (2**32))


def base36(number: Column) -> Column:
    """A non-negative number in base 36, in lower case."""
    return F.lower(F.conv(number.cast("string"), 10, 36))


def conflict_id(path: Column, chapters: Column, ours: Column, theirs: Column) -> Column:
    """The id of a conflict: path, chapters (0 for none) and short hashes of both sides."""
    places = F.array_join(F.transform(chapters, lambda c: c.cast("string")), ",")
    return F.concat(path, F.lit("#"), F.when(places == "", "0").otherwise(places), F.lit("-"), base36(hash31(ours)), F.lit("-"), base36(hash31(theirs)))


@F.pandas_udf(StringType())
def nfd(text: pd.Series) -> pd.Series:
    """Characters taken apart (NFD); the JVM side of Spark SQL has no function for it."""
    return pd.Series([None if t is None else unicodedata.normalize("NFD", t) for t in text])


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Characters put together (NFC)."""
    return pd.Series([None if t is None else unicodedata.normalize("NFC", t) for t in text])


def help_text(text: Column) -> Column:
    """Text of helps for comparison: without Hebrew accents, the maqef as a space, without zero-width characters, composed,
    white space folded and other signs at the edges taken off. Vowel points stay."""
    bare = F.regexp_replace(nfd(text), "[\u0591-\u05AF\u05BD]", "")
    bare = F.regexp_replace(F.replace(bare, F.lit("\u05be"), F.lit(" ")), "[\u200B\u200C\u200D\u2060\uFEFF]", "")
    folded = F.regexp_replace(nfc(bare), r"\s+", " ")
    return F.trim(F.regexp_replace(folded, r"^[^\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}]+$", ""))


def parse_tsv_field(field: Column) -> Column:
    """A field of a tab-separated file back from ``escape_tsv``."""
    inner = F.replace(F.regexp_extract(field, '(?s)^"(.*)"$', 1), F.lit('""'), F.lit('"'))
    return F.when(field.rlike('(?s)^".*"$'), inner).otherwise(field)


def from_base64(text: Column) -> Column:
    """UTF-8 text from base64, line ends in it ignored; null where it isn't base64."""
    return F.try_to_binary(F.regexp_replace(text, r"\s+", ""), F.lit("base64")).cast("string")


def first_int(text: Column, fallback: int = 1) -> Column:
    """The number that a text begins with; ``fallback`` without one and for 0."""
    n = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int")
    return F.when(n.isNull() | (n == 0), fallback).otherwise(n)


def fill_path(template: Column, **values: Column) -> Column:
    """A path template with each {name} replaced."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def host_name(host: Column, default: str) -> Column:
    """A host without scheme and path, in lower case; ``default`` for a blank one."""
    bare = F.trim(F.regexp_extract(F.regexp_replace(F.trim(host), r"(?i)^https?://", ""), "^([^/]*)", 1))
    return F.when(F.coalesce(bare, F.lit("")) == "", default).otherwise(F.lower(bare))


def percent_encoded(text: Column) -> Column:
    """A text as one part of an address: all but letters, digits and - _ . ! ~ * ' ( ) as percent codes."""
    out = F.url_encode(text)
    for code, char in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def raw_url(host: Column, owner: Column, repo: Column, ref: Column, path: Column, default_host: str = "localhost") -> Column:
    """The address of a file of a repository at a branch or tag (blank: master)."""
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), percent_encoded)
    branch = F.coalesce(F.trim(ref), F.lit("master"))
    return F.concat(F.lit("https://"), host_name(host, default_host), F.lit("/"), percent_encoded(owner), F.lit("/"), percent_encoded(repo), F.lit("/raw/"), percent_encoded(branch), F.lit("/"), F.array_join(parts, "/"))


def without_heading(text: Column, definition: bool = False) -> Column:
    """A Markdown text without its first main heading, and if asked for without the first definition heading behind it."""

    def place(lines: Column, start: str, after: Column) -> Column:
        """The first line behind ``after`` that begins so; the number of lines if none does."""
        hits = F.filter(F.transform(lines, lambda x, i: F.when(F.startswith(F.trim(x), F.lit(start)) & (i > after), i)), lambda i: i.isNotNull())
        return F.coalesce(F.get(hits, F.lit(0)), F.size(lines))

    def over(lines: Column) -> Column:
        def cut(first: Column) -> Column:
            second = place(lines, "## Definition:", first) if definition else F.size(lines)
            return let(second, lambda k: F.array_join(F.filter(lines, lambda x, i: (i != first) & (i != k)), "\n"))

        return let(place(lines, "# ", F.lit(-1)), cut)

    return let(F.split(text, "\n", -1), over)


def sorted_distinct(places: Column) -> Column:
    """Places in order, each once."""
    return F.array_sort(F.array_distinct(places))


def split_sid(sid: Column) -> Column:
    """struct(book, chapter, verse) of a verse id like ``TIT 1:2`` or ``1:2``; all of another text is the verse."""
    whole, bare = r"^\s*(\S+)\s+(\d+):(\d+)\s*$", r"^\s*()(\d+):(\d+)\s*$"
    made = lambda *parts: F.struct(*[p.alias(n) for n, p in zip(("book", "chapter", "verse"), parts, strict=True)])
    of = lambda pattern: made(*[F.regexp_extract(sid, pattern, k) for k in (1, 2, 3)])
    return F.when(sid.rlike(whole), of(whole)).when(sid.rlike(bare), of(bare)).otherwise(made(F.lit(""), F.lit(""), sid))


def in_range(chapter: Column, verse: Column, start: tuple[int, int], end: tuple[int, int]) -> Column:
    """Whether a verse lies in a range of verses that may go over chapters."""
    at = F.struct(chapter.try_cast("int").alias("c"), verse.try_cast("int").alias("v"))
    edge = lambda e: F.struct(F.lit(e[0]).alias("c"), F.lit(e[1]).alias("v"))
    return F.when(at["c"].isNotNull() & at["v"].isNotNull(), (at >= edge(start)) & (at <= edge(end))).otherwise(False)
