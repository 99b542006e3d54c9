"""Text formats."""

import pytest
from pyspark.sql import functions as F

from quire.operators import alignment, markup
from quire.sources import files


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "k int, t string")


def test_help_tables(spark):
    twl = "Reference\tID\tTags\tOrigWords\tOccurrence\tTWLink\nfront:intro\ta\t\t\t\t\n1:2\tb\tkeyterm\tθεός\t2\trc://*/tw/dict/bible/kt/god\nbad\tc\t\tx\t1\t\n1:3\td\t\tx\tno\trc://*/tw/dict/bible/other/a-b"
    got = files.read_word_links(texts(spark, twl, ""), "k", "t").orderBy("n").collect()
    assert [(r["id"], r["ref"]["kind"], r["occurrence"], r["link"]["type"], r["link"]["id"]) for r in got] == [("a", "book intro", 1, None, ""), ("b", "verse", 2, "tw", "kt/god"), ("d", "verse", 1, "tw", "other/a-b")]
    tn = 'Reference\tID\tTags\tSupportReference\tQuote\tOccurrence\tNote\n2:1\tx\t\t\tone & two\t1\tA "note" here'
    assert files.read_notes(texts(spark, tn), "k", "t").first()["note"] == 'A "note" here'


def test_alignment_tables(spark):
    line = "TIT\t1\t1\tα+β\t1/1+1/2\tG1+G2\tone+two\t1/1+2/3\tl+m\tx+y"
    got = files.read_alignment_tsv(texts(spark, "\t".join(files.ALIGNMENT_COLUMNS) + "\n" + line + "\nshort\tline"), "k", "t")
    r = got.first()
    assert got.count() == 1 and r["sid"] == "TIT 1:1" and [tuple(x) for x in r["targets"]] == [("one", 1, 1), ("two", 2, 3)]
    assert files.write_alignment_tsv(got).first()["line"] == line


def test_alignment_lines_are_split_once_and_keep_odd_cells(spark):
    """Cells with and without full pairs of numbers, groups of three words, a header, and fields that need quotes."""
    cells = [("a+b", "1/1+2/3"), ("a+b+c", "1/2+2/2+3/3"), ("a+b", "7"), ("a", "x/2"), ("a", "1/"), ("a", "1/1+5/6"), ("", ""), ('q"', " 1/2"), ("a", "9999999999/1")]
    text = "BOOK" + "\tx" * 9 + "\n" + "\n".join("\t".join(["TIT", "1", str(i), w, o, "G1", w, o, "l", "m"]) for i, (w, o) in enumerate(cells)) + "\r\na\tb"
    got = files.read_alignment_tsv(texts(spark, text), "k", "t")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(line") == 1
    want = [[("a", 1, 1), ("b", 2, 3)], [("a", 1, 2), ("b", 2, 2), ("c", 3, 3)], [("a", 7, 1), ("b", 1, 1)], [("a", 1, 2)], [("a", 1, 1)], [("a", 1, 1), (None, 5, 6)], [("", 1, 1)], [('q"', 1, 2)], [("a", 1, 1)]]
    assert [[tuple(x) for x in r["targets"]] for r in got.orderBy("n").collect()] == want
    lines = [r["line"] for r in files.write_alignment_tsv(got.orderBy("n"), ("n",)).orderBy("n").collect()]
    assert lines[1] == "TIT\t1\t1\ta+b+c\t1/2+2/2+3/3\tG1\ta+b+c\t1/2+2/2+3/3\tl\tm"
    assert lines[7] == 'TIT\t1\t7\t"q"""\t1/2\tG1\t"q"""\t1/2\tl\tm'


def test_alignment_sections(spark):
    got = files.read_alignment_text(texts(spark, "x → y\n== TIT 1:1 ==\nα β → one\n\n== TIT 1:2 ==\nγ → two three"), "k", "t").orderBy("n").collect()
    assert [(r["sid"], r["sources"], r["targets"]) for r in got] == [("TIT 1:1", ["α", "β"], ["one"]), ("TIT 1:2", ["γ"], ["two", "three"])]


def test_alignment_json(spark):
    group = '{"sources":[{"strong":"G1","lemma":"l","content":"c","occurrence":1,"occurrences":1}],"targets":[{"word":"w","occurrence":1,"occurrences":1}]}'
    good = '{"format":"usfm-alignment","version":"1.0","verses":{"TIT 1:1":[' + group + ',{"sources":[],"targets":[]}]}}'
    rows = alignment.groups_json(texts(spark, good, good.replace("usfm-alignment", "other"), "{bad"), "t").collect()
    assert [(r["sid"], r["group"], r["targets"][0]["word"]) for r in rows] == [("TIT 1:1", 0, "w")]


def test_journal(spark):
    text = '{"_journalHeader":1,"vectorClock":{"u":2}}\n{"id":"a","userId":"u","sequence":1,"vectorClock":{"u":1}}\nnot json\n\n{"id":"b","userId":"u","sequence":2}'
    got = files.read_journal(texts(spark, text), "k", "t")
    assert [r["id"] for r in got.orderBy("n").collect()] == ["a", "b"]
    again = files.read_journal(files.write_journal(got).select(F.lit(1).alias("k"), F.col("line").alias("t")), "k", "t")
    assert sorted((r["id"], r["sequence"]) for r in again.collect()) == [("a", 1), ("b", 2)]


def test_checking_file(spark):
    text = '{"meta":{"book":"TIT"},"entries":[{"id":"1","ref":"TIT 1:1","author":"x","type":"note"},{"id":"2"}]}'
    assert [(r["book"], r["id"]) for r in files.read_checking(texts(spark, text, "{}"), "k", "t").collect()] == [("TIT", "1")]


def test_manifests(spark):
    burrito = '{"ingredients":{"a/GEN.usfm":{"scope":{"GEN":[]}},"b/02-EXO.usfm":{},"c.md":{}}}'
    assert sorted(r["code"] for r in files.read_burrito(texts(spark, burrito), "k", "t").collect()) == ["EXO", "GEN"]
    container = "projects:\n  -\n    identifier: 'exo'\n    sort: 2\n    path: './02-EXO.usfm'\n  -\n    identifier: gen\n    sort: 1\n    path: ./01-GEN.usfm\n  - identifier: x\n    path: ./x.md\n"
    assert [r["code"] for r in files.read_container(texts(spark, container), "k", "t").collect()] == ["GEN", "EXO"]


def test_usx_to_verses(spark):
    usx = '<?xml version="1.0"?>\n<usx version="3.0">\n<book code="TIT" style="id">Titus</book>\n<chapter number="1" style="c" sid="TIT 1"/>\n<para style="p">\n<verse number="1" style="v" sid="TIT 1:1"/>Paul, a <char style="nd">servant</char> &amp; more<verse eid="TIT 1:1"/></para>\n<para style="q1">poetry</para>\n<chapter eid="TIT 1"/></usx>'
    books = files.read_usx(texts(spark, usx), "k", "t")
    got = markup.verse_texts(markup.nodes(books, "k", "text"), "k").collect()
    assert [(r["sid"], r["text"]) for r in got] == [("TIT 1:1", "Paul, a servant & more poetry")]


@pytest.mark.parametrize("name", ["a.usfm", "b.txt"])
def test_whole_files(spark, tmp_path, name):
    (tmp_path / name).write_text("line 1\nline 2")
    r = files.read_texts(spark, str(tmp_path)).first()
    assert r["path"].endswith(name) and r["text"] == "line 1\nline 2"


def test_alignment_json_is_dealt_once(spark):
    """Verses, documents and their names follow from one shuffle, and each text is parsed in one place."""
    word = F.array(F.struct(F.lit("w").alias("word"), F.lit(1).alias("occurrence"), F.lit(1).alias("occurrences")))
    source = F.array(F.struct(F.lit("G1").alias("strong"), F.lit("l").alias("lemma"), F.lit("c").alias("content"), F.lit(1).alias("occurrence"), F.lit(1).alias("occurrences")))
    rows = spark.range(40).select((F.col("id") % 4).alias("doc"), F.concat(F.lit("TIT 1:"), (F.col("id") % 8).cast("string")).alias("sid"), "id", source.alias("sources"), word.alias("targets"), F.lit("t").alias("tr"), F.lit("s").alias("src")).withColumnRenamed("id", "group")
    made = files.write_alignment_json(rows, "doc", "tr", "src")
    got = alignment.groups_json(made, "text")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert got.count() == 40 and all(r["text"].count('"id":"t"') == 1 for r in made.collect())


def test_source_report_reads_words_once(spark, tmp_path):
    """Words meet the tokens of their verse in one place for all four ways, and each word counts as itself."""
    words = [("TIT 1:1", "G1", "l", "a", 1), ("TIT 1:1", "G1", "l", "a", 1), ("TIT 1:1", "", "Lem", "b", 2), ("TIT 1:1", "", "", "c,", 1), ("TIT 1:1", "", "lem", "d", 9), ("TIT 1:1", "G9", None, "e", None), ("TIT 9:9", "G1", "l", "a", 1), ("TIT 9:9", "", "", "", 1)]
    tokens = [("tit 1:1", "g1", "x", "y", 5), ("tit 1:1", "G2", "lem", "z", 2), ("tit 1:1", "G3", "", "c", 1), ("tit 1:1", " ", "LEM", "d", 3), ("tit 1:1", "G4", "", "e", None), (None, "G1", "l", "a", 1)]
    spark.createDataFrame(words, "sid string, strong string, lemma string, content string, occurrence int").write.parquet(str(tmp_path / "w"))
    spark.createDataFrame(tokens, "sid string, strong string, lemma string, surface string, occurrence int").write.parquet(str(tmp_path / "t"))
    verses, total = alignment.source_report(spark.read.parquet(str(tmp_path / "w")), spark.read.parquet(str(tmp_path / "t")))
    assert sorted((r["sid"], r["found"], r["words"], r["matched"]) for r in verses.collect()) == [("TIT 1:1", "tit 1:1", 6, 5), ("TIT 9:9", None, 2, 0)]
    assert total.first()["verses_compared"] == 2
    # the words, their verse ids, and the tokens, with their ids in three forms
    assert verses._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("FileScan") <= 6
