"""Operators of the core library on small fixtures."""

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import alignment, catalog, checking, helps, journal, markup, similarity, versions
from quire.operators.windows import depth, evicted, joined_runs, section_numbers
from quire.plans import edit_queries
from quire.sources import files
from quire.streaming import windows as stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "part", "n", "want"), [("aaaa", "aa", 3, 2), ("abcabc", "bc", 2, 4), ("abc", "x", 1, -1), ("abc", "abc", 1, 0), ("ab", "abc", 1, -1), ("", "a", 1, -1)])
def test_nth_place_allows_overlaps(spark, text, part, n, want):
    assert one(spark, T.nth_place(F.lit(text), F.lit(part), n)) == want


def test_text_functions(spark):
    assert one(spark, T.strip_edges(F.lit("«Word's,»"))) == "Word's"
    assert one(spark, T.join_fragments(F.array(*map(F.lit, ("He", "said", ",", "(", "well", ")", "no", "."))))) == "He said,(well) no."
    join = lambda *x: one(spark, T.join_fragments(F.array(*map(F.lit, x))))
    assert join("end.", "Next") == "end. Next" and join("a", "—", "b") == "a—b" and join("3", "men") == "3 men" and join("x", " y") == "x y"
    assert join("said", "«Go") == "said «Go" and join("”", "a") == "”a" and join("'", "a") == "' a" and join("a,", "b") == "a, b" and join("a", "'s") == "a 's"
    assert one(spark, T.git_blob_id(F.lit("hello\n"))) == "ce013625030ba8dba906f756967f9e9ca394464a"
    assert one(spark, T.positional_similarity(F.lit("abcd"), F.lit("abXd"))) == 0.75 and one(spark, T.positional_similarity(F.lit(""), F.lit(""))) == 1
    assert one(spark, T.strip_tags(F.lit("a<b c='1'>d</b> < e"))) == "a d  < e"
    assert one(spark, T.escape_xml(F.lit("<a & 'b'>"))) == "&lt;a &amp; &apos;b&apos;&gt;"
    assert one(spark, T.repo_name(F.lit(" es-419 "), F.lit("My_Book: v2.1!"))) == "es-419_my_book-v2.1-"
    assert one(spark, T.hash31(F.lit("ab"))) == 97 * 31 + 98
    units = [0x61, 0xD83D, 0xDE00]
    assert one(spark, T.hash31(F.lit("a😀"))) == ((units[0] * 31 + units[1]) * 31 + units[2]) % 2**32
    assert one(spark, T.base36(F.lit(123456789).cast("long"))) == "21i3v9"
    assert one(spark, T.help_text(F.lit(" דְּבַר־יְהוָ֖ה, "))) == "דְּבַר יְהוָה" and one(spark, T.help_text(F.lit("“Amitai,”"))) == "Amitai"
    assert one(spark, T.parse_tsv_field(T.escape_tsv(F.lit('a\t"b"')))) == 'a\t"b"' and one(spark, T.parse_tsv_field(F.lit("x"))) == "x"
    assert [one(spark, T.first_int(F.lit(x).cast("string"))) for x in ("3rd", "0", "x", None, "-2")] == [3, 1, 1, 1, -2]
    assert one(spark, T.sorted_distinct(F.array(F.lit(3), F.lit(1), F.lit(3)))) == [1, 3] and one(spark, T.from_base64(F.lit("w6k=\n"))) == "é"


@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9))
@settings(max_examples=200, deadline=None)
def test_lcs(a, b):
    pairs = alignment.lcs(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and all(x < y and u < v for (x, u), (y, v) in zip(pairs, pairs[1:], strict=False))
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert len(pairs) == best[-1][-1]


def test_kept_words(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "c"], ["a", "c", "d"]), (2, None, ["x"]), (3, [], [])], "k int, old array<string>, new array<string>")
    got = {r["k"]: [tuple(x) for x in r["kept"]] for r in alignment.kept_words(rows, "old", "new").collect()}
    assert got == {1: [(0, 0), (2, 1)], 2: [], 3: []}


def test_dice_edges(spark):
    rows = spark.createDataFrame([(1, "", ""), (2, "", "long text"), (3, "a", "a"), (4, "night", "nacht"), (5, "aaaa", "aa")], "k long, a string, b string")
    got = {r["k"]: r["dice"] for r in rows.select("k", similarity.dice("a", "b").alias("dice")).collect()}
    assert got == pytest.approx({1: 1, 2: 0, 3: 1, 4: 0.25, 5: 0.5})


def test_cosine_of_nothing_is_one(spark):
    a = spark.createDataFrame([(1, "x", 3), (1, "y", 4), (2, "x", 1)], "k int, t string, n long")
    b = spark.createDataFrame([(1, "x", 3)], "k int, t string, n long")
    got = {r["k"]: r["cosine"] for r in similarity.histogram_cosine(a, b, ["k"], "t").collect()}
    assert got == pytest.approx({1: 0.6, 2: 1.0})


@pytest.mark.parametrize(("ref", "want"), [("front:intro", ("book intro", None, None)), ("FRONT:Intro", ("book intro", None, None)), ("3:intro", ("chapter intro", 3, None)), ("3:16", ("verse", 3, 16)), ("0:1", (None,)), ("1:0", (None,)), ("x", (None,)), ("a:b", (None,)), (None, (None,))])
def test_references(spark, ref, want):
    got = one(spark, helps.parse_reference(F.lit(ref).cast("string")))
    assert tuple(got)[: len(want)] == want


def test_links(spark):
    link = one(spark, helps.parse_rc(F.lit("rc://en/tw/dict/bible/kt/son-of-god")))
    assert tuple(link) == ("en", "tw", "dict", "bible/kt/son-of-god", "Son Of God")
    assert one(spark, helps.resolve_relative(F.lit("bible/kt/god.md"), F.lit("../other/son.md"))) == "bible/other/son"
    assert [one(spark, helps.occurrence(F.lit(x))) for x in ("", "x", "0", "-1", "3")] == [1, 1, 1, 1, 3]
    assert one(spark, helps.support_link(F.lit("rc://*/ta/man/translate/figs-metaphor")))["type"] == "ta"


def test_three_way_matrix(spark):
    df = lambda rows: spark.createDataFrame(rows, "k int, c string")
    base = df([(1, "a"), (2, "a"), (3, "a"), (4, "a"), (5, "a"), (6, "a"), (7, "a")])
    ours = df([(1, "a"), (2, "b"), (3, "a"), (4, "b"), (5, "b"), (7, "b"), (8, "n"), (9, "x")])
    theirs = df([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "c"), (6, "a"), (9, "y"), (10, "t")])
    got = {r["k"]: (r["action"], r["c"]) for r in versions.three_way(base, ours, theirs, "k", "c").collect()}
    assert got == {1: ("same", "a"), 2: ("ours", "b"), 3: ("theirs", "b"), 4: ("ours", "b"), 5: ("conflict", "b"), 6: ("ours", None), 7: ("conflict", "b"), 8: ("ours", "n"), 9: ("conflict", "x"), 10: ("theirs", "t")}


def test_journals_conflict_on_an_id_changed_on_both_sides(spark):
    df = lambda rows: spark.createDataFrame(rows, "id string, c string")
    merged, bad = journal.three_way_entries(df([("a", "1")]), df([("a", "2"), ("b", "1")]), df([("a", "3"), ("c", "1")]), "id", "c")
    assert [r["id"] for r in bad.collect()] == ["a"] and sorted(r["id"] for r in merged.collect()) == ["b", "c"]


@given(st.lists(st.sampled_from("abcd"), max_size=6), st.lists(st.sampled_from("abcd"), max_size=6))
@settings(max_examples=6, deadline=None)
def test_a_difference_applied_gives_the_new_version(spark, old, new):
    df = lambda rows: spark.createDataFrame([(1, i, x) for i, x in enumerate(rows)], "k int, place long, c string")
    ops = versions.diff(df(old), df(new), ["k"], "place", "c")
    made = versions.apply_ops(df(old), ops, ["k"], "place", "c").orderBy("place").collect()
    assert [r["c"] for r in made] == new


OPS = f"doc int, seq long, {versions.OP}"


def op(seq, kind, path, to=None, attr=None, value=None, old=None, doc=1):
    return (doc, seq, kind, path, to, attr, value, old)


@pytest.mark.parametrize(
    ("prior", "mine", "want"),
    [
        (op(1, "insertNode", [0, 1]), op(1, "setText", [0, 1]), ([0, 2], None)),
        (op(1, "insertNode", [0, 1]), op(1, "setText", [0, 0]), ([0, 0], None)),
        (op(1, "insertNode", [0, 1]), op(1, "setText", [1, 1]), ([1, 1], None)),
        (op(1, "insertNode", [0]), op(1, "setText", [0, 1]), ([0, 1], None)),
        (op(1, "removeNode", [0, 1]), op(1, "setText", [0, 1]), ([0, 1], None)),
        (op(1, "removeNode", [0, 1]), op(1, "setText", [0, 3]), ([0, 2], None)),
        (op(1, "setText", [2], value="x"), op(1, "setText", [2], value="y", old="a"), ([2], "x")),
        (op(1, "setText", [2], value="x"), op(1, "setText", [3], value="y", old="a"), ([3], "a")),
        (op(1, "replaceNode", [2]), op(1, "replaceNode", [2]), None),
        (op(1, "replaceNode", [2]), op(1, "setText", [2, 4]), None),
        (op(1, "replaceNode", [2, 4]), op(1, "setText", [2]), ([2], None)),
        (op(1, "replaceNode", [2]), op(1, "moveNode", [5], [2, 0]), None),
        (op(1, "setAttr", [2], attr="k"), op(1, "setAttr", [2], attr="k"), None),
        (op(1, "setAttr", [2], attr="k"), op(1, "setAttr", [2], attr="m"), ([2], None)),
        (op(1, "moveNode", [0], [3]), op(1, "setText", [2]), ([1], None)),
        (op(1, "moveNode", [5], [0]), op(1, "setText", [2]), ([3], None)),
        (op(1, "alignWord", [0]), op(1, "insertNode", [0]), ([0], None)),
    ],
)
def test_transform_rules(prior, mine, want):
    names = ["doc", "seq", "op", "path", "to", "attr", "value", "old"]
    got = versions._after(dict(zip(names, prior, strict=True)), dict(zip(names, mine, strict=True)))
    assert (None if got is None else (got["path"], got["old"])) == want


def test_transform_folds_lists(spark):
    df = lambda rows: spark.createDataFrame(rows, OPS)
    mine = df([op(1, "setText", [0, 3]), op(2, "moveNode", [0, 1], [0, 2]), op(3, "replaceNode", [0, 5]), op(1, "setText", [0, 0], doc=2)])
    prior = df([op(2, "removeNode", [0, 2]), op(1, "insertNode", [0, 0]), op(3, "replaceNode", [0, 5])])
    got = {(r["doc"], r["seq"]): (r["path"], r["to"]) for r in versions.transform(mine, prior, ["doc"]).collect()}
    assert got == {(1, 1): ([0, 3], None), (1, 2): ([0, 2], [0, 2]), (2, 1): ([0, 0], None)}
    ours, theirs = versions.transform_lists(mine, prior, ["doc"])
    assert ours.count() == 3 and theirs.columns == mine.columns
    back = versions.invert(df([op(1, "setText", [1], value="n", old="o"), op(2, "moveNode", [1], [4]), op(3, "removeNode", [2]), op(4, "insertNode", [2], value="v")]), ["doc"], "seq")
    assert [(r["op"], r["path"], r["to"], r["value"], r["old"]) for r in back.orderBy("seq").collect()] == [("removeNode", [2], None, None, "v"), ("moveNode", [4], [1], None, None), ("setText", [1], None, "o", "n")]


def test_clocks(spark):
    clock = lambda **kw: F.create_map(*[F.lit(x) for kv in kw.items() for x in kv])
    assert one(spark, journal.merge_clocks(clock(a=1, b=5), clock(b=2, c=3))) == {"a": 1, "b": 5, "c": 3}


def test_compaction_limits(spark):
    rows = spark.createDataFrame([(1, "x")] * 200 + [(2, "x")] * 201 + [(3, "y" * 1_048_577)], "k int, p string")
    assert {r["k"]: r["compact"] for r in journal.compaction_plan(rows, ["k"], F.col("p")).collect()} == {1: False, 2: True, 3: True}


def test_eviction(spark):
    rows = spark.createDataFrame([(i, 10) for i in range(10)], "at int, n long")
    assert sorted(r["at"] for r in evicted(rows, ["at"], F.col("n"), 90, 0.8).collect()) == [0, 1, 2]
    assert evicted(rows, ["at"], F.col("n"), 100, 0.8).count() == 0


def test_depth_never_goes_below_zero(spark):
    rows = spark.createDataFrame(list(enumerate([1, -1, -1, 1, 1, -1])), "i int, s int").withColumn("k", F.lit(1))
    assert [r["depth"] for r in depth(rows, ["k"], ["i"], F.col("s")).orderBy("i").collect()] == [1, 0, 0, 1, 2, 1]


def test_phrases(spark):
    rows = spark.createDataFrame([(1, 2, "a"), (1, 3, "b"), (1, 6, "c")], "k int, i int, w string")
    assert joined_runs(rows, ["k"], "i", "w").first()["phrase"] == "a b … c"


def test_checking(spark):
    entries = spark.createDataFrame([("b", 1, None), ("b", 2, 1), ("c", 1, None)], "book string, id int, old int")
    assert sorted((r["book"], r["id"]) for r in checking.active(entries, ["book"], "id", "old").collect()) == [("b", 2), ("c", 1)]
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    more = spark.createDataFrame([(2, "c"), (3, "d")], "id int, s string")
    assert sorted(map(tuple, checking.upsert(rows, more, ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, checking.merge_items(rows, more, "id").collect())) == [(1, "a"), (2, "b"), (3, "d")]


def test_formats_and_tiers(spark):
    files = spark.createDataFrame([("a", "metadata.json"), ("a", "x.usfm"), ("b", "manifest.yaml"), ("c", "01-GEN.usfm"), ("d", "x")], "repo string, path string")
    assert {r["repo"]: r["format"] for r in catalog.repo_format(files, "repo", "path").collect()} == {"a": "scripture-burrito", "b": "resource-container", "c": "raw-usfm", "d": "unknown"}
    assert [one(spark, alignment.confidence(F.lit(m), F.lit(10))) for m in (10, 9, 5, 4)] == ["exact", "high", "partial", "none"]
    assert one(spark, alignment.confidence(F.lit(0), F.lit(0))) == "exact"
    assert [one(spark, alignment.progress(F.lit(m), F.lit(n))) for m, n in ((0, 0), (1, 3), (2, 3), (7, 5))] == [0, 33, 67, 100]


def test_stream_numbers_go_on(spark, tmp_path):
    schema = "event_id long, user_id long"
    spark.createDataFrame([(1, 7), (2, 8), (3, 7)], schema).write.parquet(f"{tmp_path}/in/a")
    spark.createDataFrame([(4, 7), (5, 8)], schema).write.parquet(f"{tmp_path}/in/b")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = stream.run_once(stream.number_entries(rows), f"{tmp_path}/out").collect()
    by_user = {}
    for r in got:
        by_user.setdefault(r["user_id"], []).append(r["sequence"])
    assert {u: sorted(s) for u, s in by_user.items()} == {7: [1, 2, 3], 8: [1, 2]}


def test_stream_ingests_once(spark, tmp_path):
    rows = spark.sql("SELECT id % 5 AS event_id, timestamp_ntz'2024-01-01' AS ts FROM range(20)")
    rows.write.parquet(f"{tmp_path}/in")
    got = stream.run_once(stream.ingest_once(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/out")
    assert sorted(r["event_id"] for r in got.collect()) == [0, 1, 2, 3, 4]


def test_overlaps_join_on_first_places(spark):
    paths = [None, [], [1], [1, 2], [1, 2, 3], [1, 2, 4], [1, 3], [2, 2, 3]]
    df = lambda k: spark.createDataFrame([(k, i, p) for i, p in enumerate(paths)], "k long, op_id long, path array<long>")
    got = versions.overlaps(df(1).unionByName(df(2)), df(1), ["k"])
    short = lambda p: p is not None and len(p) < 2
    meet = lambda p, q: short(p) or short(q) or (p is not None and q is not None and p[:2] == q[:2])
    assert sorted(map(tuple, got.collect())) == sorted((1, i, j) for i, p in enumerate(paths) for j, q in enumerate(paths) if meet(p, q))
    assert "first#" in got._jdf.queryExecution().optimizedPlan().toString().split("Join ")[1].split("\n")[0]


def test_references_to_text(spark):
    def resolve(then, now, quote, start, end):
        arrays = [F.array(*map(F.lit, x)) if x is not None else F.lit(None).cast("array<string>") for x in (then, now)]
        return tuple(one(spark, similarity.resolve_reference(*arrays, F.lit(quote), F.lit(start), F.lit(end))))

    assert resolve(["In the beginning"], ["In the beginning"], "the", 3, 6) == ("exact", 3, 6)
    assert resolve(["In the beginning"], ["So in the beginning"], "the", 3, 6) == ("relocated", 6, 9)
    assert resolve(["abcdefghij"], ["abXdefghij"], "abcdefghij", 0, 10) == ("approximate", 0, 10)
    assert resolve(["abcdefghij"], ["zzz"], "cde", 2, 5) == ("stale", None, None)
    assert resolve(["a"], None, "a", 0, 1) == ("stale", None, None)
    assert resolve(["one", "two"], ["one", "two"], "one two", 0, 3) == ("exact", 0, 7)
    assert resolve(["one", "two"], ["one", "two"], "e t", 2, 1) == ("relocated", 2, 5)
    assert resolve(["one", "two"], ["one", "twX"], "one two", 0, 3) == ("approximate", 0, 7)


def test_children_are_added_in_order_and_rounded_as_in_sql(spark):
    ours, other = "<o>" + '<l q="1" s="O"/>' * 4 + "</o>", "<o>" + '<l q="1" s="O"/>' * 2 + '<l q="2" s="O"/>' * 2 + "</o>"
    rows = spark.createDataFrame([(ours, other)], "a string, b string")
    inner = 0.0
    for same in (1.0, 1.0, 0.5, 0.5):
        inner += 0.35 * same + 0.65
    assert similarity.usx_similarity(rows, "a", "b", "s").select("s.structure").first()[0] == 0.35 + 0.65 * (inner / 4)
    values = [float(f"{k}.5e-9") for k in range(200)]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(similarity.rounded(F.col("v"), 9)).collect()]
    assert sorted(got) == [x[0] for x in duckdb.sql(f"SELECT round(v, 9) AS r FROM (SELECT unnest({values}::DOUBLE[]) AS v) ORDER BY r").fetchall()]


def test_children_are_weighed_as_in_sql(spark, tmp_path):
    """Two orders of fifteen lines whose structures are just at their least value, in SQL's order of steps."""
    pairs = [0, None, 0, 0.5, 0, 0.5, 0, 0.5, 0, 1, 0.5, 0.5, 0, 0, 0.5]  # how far the lines at each place agree; None: other names
    lines = [(1, n, n, 1.0, "A", "O") for n in range(15)] + [(2, n, n, 1.0 if v else 2.0, "R" if v is None else "A", "O" if v == 1 else "F") for n, v in enumerate(pairs)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "O"), (2, "O")], "o_orderkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    duck = duckdb.connect()
    for name in ("orders", "lineitem"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = duck.execute(edit_queries.ORACLE_SQL["usx_similarity"]).fetchall()
    assert [tuple(r) for r in edit_queries.usx_similarity(spark, str(tmp_path)).collect()] == want and want[0][2] == 0.63


def test_trees_of_xml_and_json(spark):
    rows = spark.createDataFrame([(1, "<a x='1'><b/><c/></a>", "<a x='1'><b/><c/></a>"), (2, "<a x='1'><b/><c/></a>", "<a x='2' y='3'><b/></a>"), (3, "<a>", "<a/>"), (4, "<p:a xmlns:p='u'/>", "<a/>"), (5, "<a/>", "<b/>"), (6, None, "")], "k int, a string, b string")
    got = {r["k"]: r["s"] for r in similarity.usx_similarity(rows, "a", "b", "s").collect()}
    assert (got[1]["ok"], got[1]["score"]) == (True, pytest.approx(1)) and got[1]["messages"] == []
    # one of two attributes shared and different; one of two children paired
    assert got[2]["structure"] == pytest.approx(2 / 3 * (0.35 * 0 + 0.65 * 1)) and got[2]["attributes"] == pytest.approx(0.5) and got[2]["tags"] == pytest.approx(2 / (3**0.5 * 2**0.5))
    assert got[3]["messages"] == ["this one is no XML"] and not got[3]["ok"]
    assert got[4]["ok"] and got[5]["structure"] == 0 and got[5]["messages"][0] == "likeness of structures is 0.000, less than 0.63" and len(got[6]["messages"]) == 2
    tree = '{"type":"USJ","content":[{"type":"para","content":["a  b",{"type":"char","content":"c"}]},"d"]}'
    rows = spark.createDataFrame([(1, tree, tree), (2, tree, '{"type":"USJ","content":[]}'), (3, "{", tree)], "k int, a string, b string")
    got = {r["k"]: r["s"] for r in similarity.usj_similarity(rows, "a", "b", "s").collect()}
    assert got[1]["ok"] and got[1]["score"] == pytest.approx(1) and got[3]["score"] is None
    assert got[2]["messages"] == ["the other tree holds no text", "likeness of texts is 0.000, less than 0.79 (7 and 0 characters)", "likeness of node types is 0.577, less than 0.67", "their mean by weight is 0.219, less than 0.84"]
    deep = '{"type":"a","content":[' * 258 + "]}" * 258
    assert similarity._usj_errors('{"type":"USJ","version":"3","content":[' + deep + "]}")[-1].endswith("deeper than 256")


def book(*verses, head="\\id TIT\n\\c 1\n\\p\n"):
    return head + "".join(f"\\v {k} {v}\n" for k, v in enumerate(verses, 1))


def test_tagged_files_are_merged(spark):
    base = book("one", "two") + "\\c 2\n\\p\n\\v 1 three\n"
    cases = {
        "a.usfm": (base, base.replace("one", "ONE"), base.replace("three", "THREE"), base.replace("one", "ONE").replace("three", "THREE")),
        "b.usfm": (base, base.replace("one", "ONE"), base.replace("two", "TWO"), base.replace("one", "ONE").replace("two", "TWO")),
        "c.usfm": (base, base.replace("one", "ONE"), base.replace("one", "UNO"), None),
        "d.usfm": (base, base.replace("one", "ONE"), base.replace("\\v 2 two\n", "\\q\n\\v 2 two\n"), None),
        "e.usfm": (base, base + "\\c 3\n\\p\n\\v 1 four\n", base.replace("one", "UNO"), base.replace("one", "UNO") + "\\c 3\n\\p\n\\v 1 four\n"),
        "f.sfm": (base, base, base + "x", base + "x"),
        "journal/j.jsonl": ('{"id":"1"}\n', '{"id":"1"}\n{"id":"2"}\n', '{"id":"1"}\n{"id":"3"}\n', '{"id":"1"}\n{"id":"2"}\n{"id":"3"}\n'),
        "journal/k.jsonl": ('{"id":"1"}\n', '{"id":"1","a":1}\n', '{"id":"1","a":2}\n', None),
        "x.json": ('{"a": 1}', '{ "a":1 }', '{"a":2}', '{"a":2}'),
        "y.json": ('{"a": 1}', '{"a":3}', '{"a":2}', None),
        "z.png": ("1", "2", "3", None),
        "README.md": ("1", "2", "2", "2"),
        "same.txt": ("same", "same", "updated", "updated"),
        "ours.usfm": (None, base, None, base),
        "theirs.usfm": (None, None, base, base),
        "both.md": (None, "1", "1", "1"),
        "two.md": (None, "1", "2", None),
        "gone.usfm": (base, base, None, None),
        "gone.md": ("1", None, "1", None),
        "kept.usfm": (base, None, base + "x", None),
        "kept.md": ("1", "2", None, None),
        "none.md": ("1", None, None, None),
    }
    files = spark.createDataFrame([(k, *v[:3]) for k, v in cases.items()], "path string, base string, ours string, theirs string")
    got = {r["path"]: r for r in versions.merge_files(files).collect()}
    del cases["none.md"]
    assert {k: r["text"] for k, r in got.items()} == {k: v[3] for k, v in cases.items()}
    assert {k for k, r in got.items() if r["kind"] == "deleted"} == {"gone.usfm", "gone.md"}
    assert all((r["kind"] == "conflict") == (r["conflict"] is not None) == (r["text"] is None) for r in got.values() if r["kind"] != "deleted")
    assert got["c.usfm"]["conflict"].startswith("c.usfm#0,1-") and got["kept.md"]["conflict"] == "kept.md#0-1e-0" and got["kept.usfm"]["conflict"].startswith("kept.usfm#0-0-")


def test_helps_are_found_through_an_alignment(spark):
    sources = spark.createDataFrame([("v", 0, 0, "λόγος", 1), ("v", 1, 1, "θεοῦ", 1), ("v", 2, 2, "λόγος", 2), ("v", 3, 3, "καὶ", 1), ("v", 4, 4, "θεοῦ", 2), ("v", 5, 5, "λόγος", 2)], "sid string, flat int, group int, norm string, occurrence int")
    targets = spark.createDataFrame([("v", 0, "word", 1), ("v", 1, "God", 1), ("v", 2, "word", 2), ("v", 4, "God", 2), ("v", 5, "message", 1)], "sid string, group int, norm string, occurrence int")
    tokens = spark.createDataFrame([("v", i, w) for i, w in enumerate("the word of God and word of God message".split())], "sid string, place int, norm string")
    helps_ = spark.createDataFrame([("v", "first", "λόγος θεοῦ", 1), ("v", "second", "λόγος θεοῦ,", 2), ("v", "parts", "καὶ & λόγος", 1), ("v", "none", "λόγος ἄλλος", 1), ("v", "third", "θεοῦ", 3)], "sid string, id string, quote string, occurrence int")
    got = {}
    for r in helps.match_by_alignment(helps_, sources, targets, tokens, ["sid"]).collect():
        got.setdefault(r["id"], set()).add(r["place"])
    # the second word has two groups, which count together
    assert got == {"first": {1, 3}, "second": {5, 7, 8}, "parts": {1}}


def test_verses_are_resolved(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "sid string")
    got = {r["sid"]: r["found"] for r in alignment.resolve_verses(ids("TIT 1:1", "tit\u00a0 1:2", "X 1:3", "X 1:4", "none"), ids("TIT 1:1", "TIT 1:2", "TIT 1:3", "A 1:4", "B 1:4"), "sid").collect()}
    assert got == {"TIT 1:1": "TIT 1:1", "tit\u00a0 1:2": "TIT 1:2", "X 1:3": "TIT 1:3", "X 1:4": None, "none": None}
    assert tuple(one(spark, alignment.source_reference(F.lit("Alignment-Source:  some  Greek v0.30")))) == ("some Greek", "0.30")
    assert tuple(one(spark, alignment.source_reference(F.lit("something else")))) == (None, None)
    assert one(spark, alignment.source_remark(F.lit("a b"), F.lit("3"))) == "alignment-source: a b v3"
    assert one(spark, alignment.compatible_source(F.lit("TIT  Greek"), F.lit("greek"))) and not one(spark, alignment.compatible_source(F.lit(""), F.lit("x")))


def test_eviction_over_several_ranges(spark):
    rows = spark.createDataFrame([(i % 7, i, 10 + i % 3) for i in range(200)], "day int, at int, n long")
    total = sum(10 + i % 3 for i in range(200))
    left, want = total, set()
    for day, at, n in sorted((i % 7, i, 10 + i % 3) for i in range(200)):
        if left > 0.8 * (total - 1):
            want.add(at)
        left -= n
    for size in (7, 50, 1000):
        assert {r["at"] for r in evicted(rows, ["day", "at"], F.col("n"), total - 1, 0.8, range_rows=size).collect()} == want


def test_sections_are_numbered(spark):
    names = ["ts", "ts-e", "ts-s", "ts", "ts-e", "ts-e", "ts-s", "ts-s", "ts-e"]
    rows = spark.createDataFrame([(1, i, m) for i, m in enumerate(names)], "k int, i int, marker string")
    section, open_, want = 0, None, []
    for m in names:
        if m == "ts-e":
            want.append(section if open_ is None else open_)
            open_ = None
        else:
            want.append(section)
            open_ = section if m == "ts-s" else open_
            section += 1
    assert [r["section"] for r in section_numbers(rows, ["k"], "i", "marker").orderBy("i").collect()] == want


def test_alignment_text_is_read_back(spark):
    rows = spark.createDataFrame([("d", "A 1:2", 0, ["a", "b"], ["x"]), ("d", "A 1:2", 1, ["c"], ["y", "z"]), ("d", "A 1:1", 2, ["e"], ["f"])], "doc string, sid string, n int, sources array<string>, targets array<string>")
    text = files.write_alignment_text(rows, "doc")
    got = files.read_alignment_text(text, "doc", "text").orderBy("n").collect()
    assert [(r["sid"], r["sources"], r["targets"]) for r in got] == [("A 1:2", ["a", "b"], ["x"]), ("A 1:2", ["c"], ["y", "z"]), ("A 1:1", ["e"], ["f"])]


def test_snapshots_are_aligned(spark):
    want = spark.createDataFrame([(1, 0, 3, 1), (1, 1, 3, 2), (2, 0, 3, 9)], "k int, place int, chapter int, verse int")
    have = spark.createDataFrame([(1, 3, 2, "b"), (1, 3, 1, "a"), (2, 3, 1, "c")], "k int, chapter int, verse int, text string")
    assert [tuple(r) for r in similarity.aligned_snapshots(want, have, ["k"]).collect()] == [(1, ["a", "b"])]


def test_conflicts_may_be_resolved_by_a_rule(spark):
    df = lambda rows: spark.createDataFrame(rows, "k int, c string")
    sides = [df([(1, x), (2, "s")]) for x in ("a", "b", "c")]
    got = lambda choose: {r["k"]: (r["action"], r["c"]) for r in versions.three_way(*sides, "k", "c", choose).collect()}
    assert got(None)[1] == ("conflict", "b") and got(lambda b, o, t: t)[1] == ("conflict", "c") and got(lambda b, o, t: F.concat(o, t)) == {1: ("conflict", "bc"), 2: ("same", "s")}


def test_fragments_and_originals(spark):
    rows = spark.createDataFrame([(1, "\\p\n\\v 3 a \\w b|lemma=\"l\" strong=\"G1\"\\w*\\w b\\w*\\f + \\ft note\\f*", "TIT", 2)], "k int, text string, book string, chapter int")
    node = markup.fragment_nodes(rows, "k", "text", "book", "chapter")
    assert [(r["pos"], r["marker"], r["sid"]) for r in node.where("NOT closing").orderBy("pos").collect()][:2] == [(0, "p", None), (1, "v", "TIT 2:3")]
    assert markup.verse_texts(node, "k").first()["text"] == "a b b" and markup.verse_texts(node, "k", notes=True).first()["text"] == "a b b note"
    words = [tuple(r)[2:] for r in alignment.original_tokens(node, "k").orderBy("place").collect()]
    assert words == [(0, "b", "G1", "l", "", 1, 2), (1, "b", "", "", "", 2, 2)]
    books = spark.createDataFrame([(1, "\\id A\n\\usfm 3.0\n\\rem other\n\\rem alignment-source: Greek v1\n\\rem alignment-source: UGNT v0.9\n"), (2, "\\id B\n\\usfm x")], "k int, text string")
    assert [tuple(r) for r in alignment.document_source(markup.nodes(books, "k", "text"), "k").collect()] == [(1, "UGNT", "0.9")]
    log = markup.parse_log(markup.typed(markup.tokens(books, "k", "text"), "k"), "k").collect()
    assert sorted((r["k"], r["message"]) for r in log) == [(1, "\\usfm: version isn't 3.1"), (2, "\\usfm: version isn't 3.1")]


def test_alignment_states_and_quotes_with_accents(spark):
    rows = spark.createDataFrame([(1, True, True), (1, False, False), (2, True, False), (3, False, True), (4, False, False)], "k int, m boolean, s boolean")
    got = {r["k"]: r["state"] for r in alignment.alignment_state(rows, "k", F.col("m"), F.col("s")).collect()}
    assert got == {1: "aligned", 2: "has-markers-no-provenance", 3: "unaligned", 4: "unaligned"}
    word, other = "\u05d1\u05b0\u05e8\u05b5\u05d0\u05e9\u05b4\u05c1\u05d9\u05ea", "\u05d0\u05ea"
    norm = [one(spark, T.help_text(F.lit(w))) for w in (word, other)]
    sources = spark.createDataFrame([("v", 0, 0, norm[0], 1), ("v", 1, 1, norm[1], 1)], "sid string, flat int, group int, norm string, occurrence int")
    targets = spark.createDataFrame([("v", 0, "beginning", 1), ("v", 1, "the", 1)], "sid string, group int, norm string, occurrence int")
    tokens = spark.createDataFrame([("v", i, w) for i, w in enumerate("in the beginning".split())], "sid string, place int, norm string")
    asked = spark.createDataFrame([("v", "h", word[:3] + "\u0596" + word[3:] + "\u05be" + other, 1)], "sid string, id string, quote string, occurrence int")
    assert {r["place"] for r in helps.match_by_alignment(asked, sources, targets, tokens, ["sid"]).collect()} == {1, 2}


def test_branches_and_waits(spark):
    assert one(spark, T.branch_name(F.lit(" TIT "), F.lit("A b/C"))) == "a-b-c/tit" and one(spark, T.branch_name(F.lit("1JN"))) == "1jn"
    assert [one(spark, T.retry_delay(F.lit(n))) for n in (0, 2, 4, 99)] == [30_000, 600_000, 7_200_000, 7_200_000]
    assert [one(spark, T.download_wait(F.lit(n))) for n in (0, 1, 4, 5, 1000)] == [2_000, 4_000, 32_000, 60_000, 60_000]


def test_usj_similarity_asks_python_once(spark):
    """Both trees and their likeness come from one call, so texts don't go back and forth."""
    rows = spark.createDataFrame([(1, '{"type":"USJ","content":["ab c"]}', '{"type":"USJ","content":["ab", " c"]}'), (2, "{", None), (3, '"x"', "[]")], "k int, a string, b string")
    made = similarity.usj_similarity(rows, "a", "b", "s")
    assert made._jdf.queryExecution().executedPlan().toString().count("EvalPython ") == 1
    assert {r["k"]: (r["s"]["text_similarity"], r["s"]["ok"]) for r in made.collect()} == {1: (1.0, True), 2: (None, None), 3: (0.0, False)}


def test_chapters_are_edited_in_one_order_of_rows(spark):
    """Replaced, deleted and renumbered chapters, with books and chapters that aren't there or have no name, without a join."""
    schema = "book string, chapter long, place long, content long"
    rows = spark.createDataFrame([("a", 1, 0, 1), ("a", 1, 1, 2), ("a", 2, 0, 3), ("a", 2, 0, 3), ("a", 3, 0, 4), ("b", 2, 0, 5), ("b", 7, 0, 6), ("c", None, 0, 7), (None, 2, 0, 8), (None, 3, 0, 9)], schema)
    new = spark.createDataFrame([("a", 1, 0, -1), ("b", 1, 0, -2), ("c", None, 0, -3), (None, 2, 0, -4)], schema)
    gone = spark.createDataFrame([("a", 3), ("b", 9), ("c", None), (None, 3)], "book string, chapter long")
    moves = spark.createDataFrame([("a", 2, 3), ("b", 2, 7), ("b", 7, 0), ("c", None, 4), (None, 2, 6)], "book string, chapter long, new long")
    out = versions.edit_chapters(rows, "book", new, gone, moves)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
    said = lambda df: sorted(map(str, map(tuple, df.collect())))
    rest = [("b", 2, 0, 5), ("b", 7, 0, 6), ("c", None, 0, 7), (None, 2, 0, 8), (None, 3, 0, 9)]
    assert said(out) == sorted(map(str, [("a", 1, 0, -1), ("a", 3, 0, 3), ("a", 3, 0, 3), *rest]))
    one = versions.renumber_chapters(versions.delete_chapters(versions.replace_chapters(rows, new, "book"), gone, "book"), moves, "book")
    assert said(one) == said(out)
    assert said(versions.replace_chapters(rows, new, "book", add=True)) == sorted(map(str, [("a", 1, 0, -1), ("a", 2, 0, 3), ("a", 2, 0, 3), ("a", 3, 0, 4), ("b", 1, 0, -2), ("c", None, 0, -3), (None, 2, 0, -4), *rest]))
