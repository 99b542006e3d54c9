"""Tagged text: tokens, nodes, verse texts, renderers."""

import json
import re

import pytest
from pyspark.sql import functions as F

from quire.functions import markers
from quire.functions.markers import dim_marker
from quire.operators import alignment, markup
from quire.operators.windows import depth
from quire.plans import format_queries, structure_queries

BOOKS = {
    1: "\\id GEN A test\n\\h Genesis\n\\mt1 Genesis\n\\c 1\n\\p\n\\v 1 In the \\add very\\add* beginning\n\\v 2 And the earth\\f + \\ft A note.\\f* was\n\\q1 poetry\n\\c 2\n\\p\n\\v 1a-2 Next, \\w word|lemma=\"w\" strong=\"H1\"\\w* and \\w plain|bare\\w*.",
    2: "\\id EXO\n\\c 1\n\\zpara custom\n\\v 1 x \\zodd odd\\zodd* y \\qt-s |who=\"God\"\\*said\\qt-e\\* z",
    3: "\\id LEV\n\\c 1\n\\tr \\th1 A \\thr2-3 B\n\\tr \\tc1 1 \\tcr2-3 2",
    4: "",
    5: None,
    6: "no markers at all",
    7: "\\id NUM\n\\c 1\n\\p\n\\v 1 \\zaln-s |x-strong=\"G1\" x-content=\"ena\" x-occurrence=\"1\" x-occurrences=\"1\"\\*\\w one|x-occurrence=\"1\" x-occurrences=\"2\"\\w*\\zaln-e\\* two \\zaln-s |x-strong=\"G2\" x-content=\"dio\"\\*\\zaln-s |x-strong=\"G3\" x-content=\"tria\"\\*\\w big|x-occurrence=\"1\"\\w* \\w one|x-occurrence=\"2\" x-occurrences=\"2\"\\w*\\zaln-e\\*\\zaln-e\\*",
}


@pytest.fixture(scope="module")
def node(spark):
    return markup.nodes(spark.createDataFrame(list(BOOKS.items()), "doc_id long, text string"), "doc_id", "text").cache()


def test_verse_texts(node):
    got = {(r["doc_id"], r["sid"]): r["text"] for r in markup.verse_texts(node, "doc_id").collect()}
    assert got[1, "GEN 1:1"] == "In the very beginning"
    assert got[1, "GEN 1:2"] == "And the earth was poetry"
    assert got[1, "GEN 2:1a-2"] == "Next, word and plain."
    assert got[2, "EXO 1:1"] == "x odd y said z"
    with_notes = {r["sid"]: r["text"] for r in markup.verse_texts(node, "doc_id", notes=True).collect()}
    assert with_notes["GEN 1:2"] == "And the earth A note. was poetry"


def test_kinds_are_judged_by_document(node):
    kinds = {r["marker"]: r["kind"] for r in node.where("doc_id = 2 AND NOT closing").collect()}
    assert (kinds["zpara"], kinds["zodd"], kinds["qt-s"]) == ("paragraph", "character", "milestone")


def test_context_and_attributes(node):
    rows = node.where("doc_id = 1").orderBy("pos").collect()
    assert {r["chapter"] for r in rows} == {None, "1", "2"} and {r["book"] for r in rows} == {"GEN"}
    words = [r["attrs"] for r in rows if r["marker"] == "w" and not r["closing"]]
    assert words == [{"lemma": "w", "strong": "H1"}, {"lemma": "bare"}]
    assert all(r["depth"] >= 0 for r in rows) and any(r["in_note"] for r in rows)
    assert node.where("doc_id IN (4, 5, 6)").count() == 0


def test_chapters(node):
    got = {(r["doc_id"], r["chapter"]): r["n_verses"] for r in markup.chapters(node, "doc_id").collect()}
    assert got[1, "0"] == 0 and got[1, "1"] == 2 and got[1, "2"] == 1


def test_round_trip(spark):
    books = spark.createDataFrame([(k, v) for k, v in BOOKS.items() if v and v.startswith("\\")], "doc_id long, text string")
    again = markup.render_usfm(markup.tokens(books, "doc_id", "text"), "doc_id")
    assert {r["doc_id"]: r["text"] for r in again.collect()} == {k: v for k, v in BOOKS.items() if v and v.startswith("\\")}


def test_xml_is_well_formed(node):
    from xml.etree import ElementTree

    for r in markup.render_xml(node, "doc_id").where("doc_id IN (1, 2, 7)").collect():
        tree = ElementTree.fromstring(f"<usx>{r['text']}</usx>")
        starts, ends = (sorted(v.get(k) for v in tree.iter("verse") if v.get(k)) for k in ("sid", "eid"))
        assert starts == ends
    html = markup.render_xml(node, "doc_id", html=True).where("doc_id = 1").first()["text"]
    assert html.count("<p ") == html.count("</p>") and "<sup>" in html


def test_alignment_groups(node):
    rows = alignment.strip_alignment(node.where("doc_id = 7"), "doc_id").orderBy("group", "pos").collect()
    assert [(r["group"], r["role"], r["word"], r["occurrence"]) for r in rows] == [(0, "source", "ena", 1), (0, "target", "one", 1), (1, "source", "dio", 1), (1, "source", "tria", 1), (1, "target", "big", 1), (1, "target", "one", 2)]


def test_marker_dimension(spark):
    rows = markers.dim_marker(spark, [("zx", "note", "note"), ("p", "character", "char")]).collect()
    kinds = {r["marker"]: r["kind"] for r in rows}
    assert len(rows) == len(kinds) == 306 and kinds["zx"] == "note" and kinds["p"] == "character" and kinds["tcr8"] == "character"



def test_cells(spark):
    got = spark.createDataFrame([("tc1",), ("thr2-4",), ("tcc3",), ("p",)], "m string").select("m", markers.cell_span("m").alias("s"), markers.cell_align("m").alias("a")).collect()
    assert [tuple(r) for r in got] == [("tc1", 1, "start"), ("thr2-4", 3, "end"), ("tcc3", 1, "center"), ("p", None, "start")]


def test_nodes_keep_one_order(spark):
    """Verse, depth and notes are running values in a book's own order: rows are sorted anew for the closers of notes alone."""
    books = spark.createDataFrame([(1, "\\id TIT\n\\c 1\n\\p\n\\v 1 a \\nd b\\nd* c")], "k int, text string")
    plan = markup.render_xml(markup.nodes(books, "k", "text"), "k")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bSort \[", plan)) <= 3
    usj = markup.to_usj(markup.nodes(books, "k", "text"), "k")._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in usj and len(re.findall(r"\bSort \[", usj)) <= 3


def test_depth_begins_anew_in_each_part(spark):
    steps = [(0, -1), (0, 1), (0, 1), (1, 1), (1, -1), (1, -1), (1, 1), (2, 0), (3, -1), (3, -1), (3, 1), (3, 1), (3, -1)]
    rows = spark.createDataFrame([(1, n, p, s) for n, (p, s) in enumerate(steps)], "k int, n int, p int, s int")
    one = {r["n"]: r["depth"] for r in depth(rows, ["k"], ["n"], F.col("s"), part="p").collect()}
    each = {r["n"]: r["depth"] for r in depth(rows, ["k", "p"], ["n"], F.col("s")).collect()}
    assert one == each == dict(enumerate([0, 1, 2, 1, 0, 0, 1, 0, 0, 0, 1, 2, 1]))
    text = "\\id TIT\n\\c 1\n\\p\n\\v 1 a\n\\c 2\n\\p b\n\\v 1 c\n\\c 3\n\\v d"
    books = spark.createDataFrame([(1, text)], "k int, text string")
    got = [(r["marker"], r["verse"]) for r in markup.nodes(books, "k", "text").orderBy("pos").collect()]
    assert got == [("id", None), ("c", None), ("p", None), ("v", "1"), ("c", None), ("p", None), ("v", "1"), ("c", None), ("v", "d")]


def test_bars_in_verses_and_names_that_come_again(spark, tmp_path):
    """A bar in a verse is text, and names that come again after one are no error."""
    books = spark.createDataFrame([(1, '\\id TIT\n\\c 1\n\\p\n\\v 1 a | t = "x" | t = "y"\n\\v 2 \\w b|n="1" lemma="c" n="2  3" n=""\\w*')], "k int, text string")
    rows = {(r["marker"], r["verse"]): r for r in markup.nodes(books, "k", "text").withColumn("names", F.map_keys("attrs")).where("NOT closing").collect()}
    assert rows["v", "1"]["text"] == 'a | t = "x" | t = "y" ' and rows["v", "1"]["attrs"] == {}
    assert rows["w", "2"]["attrs"] == {"n": "2 3", "lemma": "c"} and rows["w", "2"]["names"] == ["n", "lemma"]
    docs = spark.createDataFrame([(1, 'a | token = "x" | b | token = "y"\nc'), (2, 'token="x" token="y" | token="z" token="z"')], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, structure_queries.render_usx(spark, str(tmp_path)).collect())) == [(1, 2, 2, 2, 2), (2, 2, 2, 1, 1)]


def test_trees_of_lines_with_names_that_come_again(spark, tmp_path):
    docs = spark.createDataFrame([(1, 'a | token = "x" | b | token = "y"\nc'), (2, 'token="x" token="y" | token="z" token="z"')], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, format_queries.usj_tree(spark, str(tmp_path)).collect())) == [(1, "USJ", "1", 2), (2, "USJ", "1", 1)]
    books = spark.createDataFrame([(1, '\\id TIT\n\\c 1\n\\p\n\\v 1 a | t = "x" | t = "y" \\w b|n="1" lemma="c" n="2"\\w*')], "k int, text string")
    tree = json.loads(markup.to_usj(markup.nodes(books, "k", "text"), "k").first()["usj"])
    assert tree["content"][-1]["content"][1:] == ['a | t = "x" | t = "y" ', {"type": "char", "marker": "w", "n": "2", "lemma": "c", "content": ["b"]}]
