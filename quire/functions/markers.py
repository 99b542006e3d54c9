"""The marker dimension: what each built-in marker of the tagged text stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the markup standard: type, role of the style, names.
FAMILIES = (
    ("paragraph", "book", "id"),
    ("paragraph", "chapter", "c"),
    ("paragraph", "other", "usfm cp esbe"),
    ("paragraph", "heading", "h"),
    ("paragraph", "break", "ib b sd"),
    ("paragraph", "sidebar", "esb"),
    ("paragraph", "periph", "periph"),
    ("paragraph", "row", "tr"),
    ("paragraph", "para", "ide h1 h2 h3 toc1 toc2 toc3 toca1 toca2 toca3 rem sts restore"),
    ("paragraph", "para", "imt imte is iot io ip im ipi imi ili ipq imq ipr iq iex ie"),
    ("paragraph", "para", "cl cd p m po pr cls pmo pm pmc pmr pi pc mi nb q qc qr qa qm qd"),
    ("paragraph", "para", "mt mte ms mse ms2e ms3e mr s s1e s2e s3e s4e sr r sp d"),
    ("paragraph", "para", "lh li lf lim erq erqe lit pb p1 p2 k1 k2 ph phi ps psi"),
    ("paragraph", "para", "pub toc pref intro conc glo idx maps cov spine pubinfo"),
    ("character", "verse", "v"),
    ("character", "number", "ca va vp"),
    ("character", "figure", "fig"),
    ("character", "ref", "ref"),
    ("character", "cell", "th1 th2 th3 th4 th5 th6 th7 th8 tc1 tc2 tc3 tc4 tc5 tc6 tc7 tc8 thc1 thc2 thc3 thc4 thc5 thc6 thc7 thc8 tcc1 tcc2 tcc3 tcc4 tcc5 tcc6 tcc7 tcc8 thr1 thr2 thr3 thr4 thr5 thr6 thr7 thr8 tcr1 tcr2 tcr3 tcr4 tcr5 tcr6 tcr7 tcr8"),
    ("character", "char", "ior iqt qs qac litl lik liv rq cat qt nd tl dc bk sig pn png addpn wj k sls ord add no"),
    ("character", "char", "it bd bdit em sc sup jmp pro rb w wh wg wa ndx xtSee xtSeeAlso wr zpa-xb zpa-xc zpa-xv zpa-d efm"),
    ("character", "note part", "fr ft fk fq fqa fl fw fp fs fv fdc fm xo xop xt xta xk xq xot xnt xdc"),
    ("note", "note", "f fe x ef ex efe"),
    ("milestone", "ms", "ts ts-s ts-e qt-s qt-e qt1-s qt1-e qt2-s qt2-e t zaln-s zaln-e"),
)
#: How many numbered levels these names have, from 1.
LEVELS = {"sd": 4, "tr": 2, "imt": 4, "imte": 2, "is": 2, "io": 4, "ili": 2, "iq": 3, "pi": 3, "q": 4, "qm": 3, "mt": 4, "mte": 2, "ms": 3, "s": 4, "li": 4, "lim": 4, "ph": 3, "liv": 4}
#: The attribute that a bare value after the bar stands for.
DEFAULT_ATTRIBUTE = {"k": "link-href", "jmp": "link-href", "rb": "gloss", "w": "lemma", "ref": "loc"}


def dim_marker(spark: SparkSession, extra: list[tuple[str, str, str]] = ()) -> DataFrame:
    """(marker, kind, style, default_attribute): the built-in markers and ``extra`` ones. Later entries replace earlier."""
    names = ((kind, style, n, k) for kind, style, listed in FAMILIES for n in listed.split() for k in range(LEVELS.get(n, 0) + 1))
    rows = {m: (m, kind, style, DEFAULT_ATTRIBUTE.get(m)) for kind, style, n, k in names for m in [f"{n}{k or ''}"]}
    rows |= {m: (m, kind, style, None) for m, kind, style in extra}
    return spark.createDataFrame(list(rows.values()), "marker string, kind string, style string, default_attribute string")


def base_marker(marker: Column) -> Column:
    """A marker's name without level and milestone end, by which unlisted levels are looked up."""
    return F.regexp_replace(marker, r"(\d+(-\d+)?)?(-[se])?$", "")


def cell_span(marker: Column) -> Column:
    """How many columns a table cell covers: ``tc1-2`` covers 2."""
    m = lambda k: F.regexp_extract(marker, r"^t[hc][cr]?(\d+)(?:-(\d+))?$", k)
    return F.when(m(1) == "", None).when(m(2) == "", 1).otherwise(m(2).cast("int") - m(1).cast("int") + 1)


def cell_align(marker: Column) -> Column:
    side = F.regexp_extract(marker, r"^t[hc]([cr]?)\d", 1)
    return F.when(side == "r", "end").when(side == "c", "center").otherwise("start")


def well_formed(marker: Column) -> Column:
    return (F.length(marker) <= 128) & marker.rlike(r"^[A-Za-z][A-Za-z0-9]*(-[A-Za-z0-9]+)*$")
