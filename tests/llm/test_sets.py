"""Near-duplicates, decontamination, repeated lines and repeated substrings against plain versions."""

import hashlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import decontaminate, line_dedup, near_dedup, substring_dedup
from quire.llm.blocks import pack, unpack
from quire.llm.scratch import cut
from tests.llm.helpers import SCHEMA, lower, odd_documents, prose, rows_of, words


@pytest.fixture(scope="module")
def docs(spark):
    return cut(spark.createDataFrame(odd_documents(), SCHEMA), "test-docs")


def shingle_set(text, size):
    w = words(lower(text))
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def plain_components(texts, size, percent):
    sets = {i: shingle_set(t, size) for i, t in texts.items()}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}, sets


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, size, percent):
    texts = {i: t for i, t, *_ in odd_documents() if i is not None}
    label, sets = plain_components(texts, size, percent)
    got = rows_of(near_dedup.near_duplicates(docs, size=size, percent=percent).select("doc_id", "n_shingles", "component_id", "kept"))
    assert len(got) == len(odd_documents())
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), label[r["doc_id"]], label[r["doc_id"]] == r["doc_id"])


def test_near_duplicates_in_a_chain_and_across_a_bucket(spark):
    """Copies a few words apart: neighbours are linked, ends are not; all are one component."""
    base = prose(5, 300).split()
    texts = {}
    for i in range(30):
        w = list(base)
        for k in range(i + 1):
            w[9 * k] = f"changed{k}"
        texts[i] = " ".join(w)
    label, _ = plain_components(texts, 3, 85)
    got = near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), size=3, percent=85)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == label


def test_links_go_on_below_those_that_chance_may_have_made():
    import numpy as np
    import pandas as pd

    own = np.arange(100, dtype=np.uint32)
    # shares of x's fingerprints: of component 7 in the order 86, 93, 99, 90 of 100, of 8 one below the limit and one at it
    rows = [(0, 1, 100), (1, 7, 93), (2, 7, 99), (3, 7, 94), (4, 8, 91), (5, 8, 92), (6, 9, 93), (7, 9, 92)]
    items = [np.concatenate((own[:k], 1000 + 100 * i + own[k:])).astype(np.uint32) for i, _, k in rows]
    pdf = pd.DataFrame({"key": 0, "id": [r[0] for r in rows], "comp": [r[1] for r in rows], "filled": 100, "size": 100, "left": False, "x": 0, "y": 0})
    pdf["sketch"], pdf["bands"], pdf["items"] = [near_dedup.odd_sketch(np.sort(x.astype(np.uint64) << np.uint64(32)))[1] for x in items], [[0]] * len(rows), [np.sort(x).tobytes() for x in items]
    links = near_dedup.Bucket(pdf)._best(0, np.arange(1, 8), 85)
    # 2 is sure, so 1 and 3 aren't needed; 5 may be by chance and 4 is too far; neither 6 nor 7 is sure
    assert sorted(map(tuple, links.tolist())) == [(0, 2), (0, 5), (0, 6), (0, 7)]


def test_near_duplicates_of_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert near_dedup.near_duplicates(none).count() == 0
    assert near_dedup.drop_near_duplicates(none).columns == none.columns


def test_one_of_each_group_stays(docs):
    kept = near_dedup.drop_near_duplicates(docs, size=3, percent=85)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 3 in ids and not {20, 21, 22} & set(ids) and ids.count(None) == 2 and ids.count(8) == 2


def test_components_of_a_path(spark):
    edges = cut(spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 91)], "a long, b long"), "test-edges")
    got = {r["id"]: r["label"] for r in near_dedup.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 91: 90}


ITEMS = [(1, prose(3, 60)[:200]), (2, prose(200, 30)), (3, "too few words"), (4, None), (5, prose(7, 40)), (6, prose(7, 40)), (None, prose(1, 40))]


def test_decontamination(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    sets = defaultdict(set)
    for i, t, *_ in odd_documents():
        sets[i] |= shingle_set(t, 5) if len(words(t)) >= 5 else set()
    want = {}
    for item, t in ITEMS:
        s = shingle_set(t, 5) if len(words(t)) >= 5 else set()
        for i, have in sets.items():
            if s and item is not None and i is not None and 100 * len(s & have) >= 80 * len(s):
                want[i, item] = (len(s & have), len(s))
    got = decontaminate.contaminated(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]): (r["n_shared"], r["n_item"]) for r in got} == want and len(got) == len(want) > 3
    left = decontaminate.decontaminate(docs, items)
    assert left.columns == docs.columns
    assert left.count() == sum(i is None or not any(i == d for d, _ in want) for i, *_ in odd_documents())
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_an_item_with_changed_words_is_found(spark):
    w = prose(11, 300).split()
    item = w[100:140]
    item[8] = item[39] = "changed"
    item[20] = "other"
    docs = spark.createDataFrame([(1, " ".join(w)), (2, prose(12, 300))], "doc_id long, text string")
    got = decontaminate.contaminated(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert not got  # 25 of 36 shingles
    item[8] = w[108]
    got = decontaminate.contaminated(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 7)]


def plain_lines(rows):
    """What each (id, text) keeps, in the order of ids and then of ``hashes``: (lines, removed, text)."""
    seen, want = set(), {}
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        trimmed = [x.strip(" \t\r\x0b\f") for x in lines]
        gone = set()
        for k in range(len(lines) - 2):
            w = tuple(trimmed[k : k + 3])
            if any(w):
                if w in seen:
                    gone |= {k, k + 1, k + 2}
                seen.add(w)
        want[i, t] = (len(lines), len(gone), t if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return want


def lines_order(df):
    """Distinct (id, text, hash) in the operator's order, without null ids."""
    rows = df.selectExpr("doc_id", "text", "xxhash64(text) AS h").where("doc_id IS NOT NULL").distinct().collect()
    return sorted(map(tuple, rows), key=lambda r: (r[0], r[2]))


def test_repeated_lines(docs):
    want = plain_lines(lines_order(docs))
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "line_stats"]
    for r in got.select("doc_id", "line_stats").collect():
        assert r["doc_id"] is not None or r["line_stats"]["n_removed"] == 0
    before = docs.selectExpr("doc_id", "coalesce(n_chars, -1) AS c", "text AS old")
    pairs = got.selectExpr("doc_id AS d", "coalesce(n_chars, -1) AS e", "text", "line_stats").join(before, F.expr("d = doc_id AND e = c")).distinct()
    assert pairs.count() == len(want)
    for r in pairs.collect():
        assert (r["line_stats"]["n_lines"], r["line_stats"]["n_removed"], r["text"]) == want[r["doc_id"], r["old"]]
    assert got.where("line_stats.n_removed > 0").count() > 3
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_rows_that_share_an_id_lose_their_own_lines_only(spark):
    texts = ["p q r s", "p q r s", "v w x y z", "a b c d e f", "v w x y z", "c d e f g"]
    ids = [1, 2, 2, 3, 3, 3]
    rows = [(i, t.replace(" ", "\n"), k, 7, "x") for k, (i, t) in enumerate(zip(ids, texts, strict=True))] + [(None, "p\nq\nr", 8, 7, "x")] * 2 + [(3, "c\nd\ne\nf\ng", 9, 7, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, pos int, h1 string")
    want = plain_lines(lines_order(df))
    got = line_dedup.dedup_lines(df).collect()
    assert len(got) == len(rows)
    for r in got:
        i, t, *_ = rows[[x[2] for x in rows].index(r["row"])]
        assert (r["line_stats"]["n_lines"], r["line_stats"]["n_removed"], r["text"]) == (want[i, t] if i is not None else (3, 0, t))
    kept = Counter(x for r in got for x in r["text"].split("\n"))
    assert set(kept) - {""} == set("pqrsvwxyzabcdefg")


def plain_spans(texts, length):
    raw = [(t or "").encode() for t in texts]
    n = Counter(x[k : k + length] for x in raw for k in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = bytearray(len(x))
        for k in range(len(x) - length + 1):
            if n[x[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans, at = [], 0
        while (start := gone.find(1, at)) >= 0:
            at = gone.find(0, start)
            at = len(x) if at < 0 else at
            spans.append((start, at))
        out.append((len(x), spans, hashlib.sha256(bytes(b for b, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("length", [200, 80])
def test_repeated_substrings(docs, length):
    texts = [t for _, t, *_ in odd_documents()]
    want = sorted((repr(i), x) for (i, *_), x in zip(odd_documents(), plain_spans(texts, length), strict=True))
    got = substring_dedup.repeated_spans(docs, length=length).collect()
    have = [(repr(r["doc_id"]), (r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], hashlib.sha256(bytes(r["kept"])).hexdigest())) for r in got]
    assert sorted(have) == want
    assert any(x[1] for _, x in want)


def test_substrings_of_mixed_pieces(spark):
    """Pieces of two texts in many arrangements, where a suffix's equals lie inside longer ties of others."""
    a, b = prose(31, 400), prose(32, 400)
    texts = [a, b, a[100:900] + b[300:700], b[250:640] + a[333:590], a[:450], b[77:340], a[120:330], b[500:701], "zz" + a[500:705], "y" * 450, "q" + "y" * 230]
    got = substring_dedup.repeated_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    have = [(r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got.orderBy("doc_id").collect()]
    assert have == plain_spans(texts, 200)


def test_substrings_of_no_rows(spark):
    assert substring_dedup.repeated_spans(spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_cover_is_a_difference_cover():
    p, c = substring_dedup.PERIOD, substring_dedup.COVER
    assert {(a - b) % p for a in c for b in c} == set(range(p))


@given(st.lists(st.integers(0, 2**64 - 1)))
@settings(max_examples=50, deadline=None)
def test_packing(keys):
    import numpy as np

    assert unpack(pack(np.array(sorted(keys), np.uint64))).tolist() == sorted(keys)
