"""Mixing, token files and the pipeline."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import mixing, pieces, queries, token_files
from quire.llm.scratch import cut, new_path
from tests.llm.helpers import SCHEMA, odd_documents, prose, words
from tests.llm.test_models import plain_statistics
from tests.llm.test_sets import plain_components, shingle_set


@pytest.fixture(scope="module")
def docs(spark):
    return cut(spark.createDataFrame(odd_documents(), SCHEMA), "test-docs")


def plain_targets(size, weight, share, most):
    """Clamp and redistribute until none is above its limit."""
    target, open_, budget = {}, set(size), share * sum(size.values())
    while open_:
        left = budget - sum(target.values())
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * size[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: most * size[s] for s in over}
        open_ -= over
    return target


def test_mix(docs):
    rows = odd_documents()
    size = defaultdict(int)
    for _, t, _, s, _ in rows:
        size[s] += len(words(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = plain_targets(size, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5, 2)
    got = mixing.mix(docs)
    assert got.columns == [*docs.columns, "mix"]
    taken, largest, again = defaultdict(int), defaultdict(int), mixing.mix(docs)
    for r in got.collect():
        m, s = r["mix"], r["source"]
        assert m["size"] == len(words(r["text"])) and m["source_size"] == size[s] and m["target"] == pytest.approx(want[s])
        assert m["copies"] in (0, 1, 2) and m["taken"] == m["copies"] * m["size"]
        taken[s] += m["taken"]
        largest[s] = max(largest[s], m["size"])
    for s in size:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    key = lambda df: sorted((repr(r["doc_id"]), r["mix"]["taken"]) for r in df.collect())
    assert key(got) == key(again)
    repeated = mixing.repeated(got)
    assert repeated.columns == docs.columns and repeated.count() == sum(r["mix"]["copies"] for r in got.collect())
    assert mixing.mix(docs.limit(0)).count() == 0


def test_rows_that_share_an_id_are_taken_each_for_itself(spark):
    """A third of all rows have a null id and one text, others repeat an id; the sizes differ between sources."""
    rows = [(None, "a b c d e f g h", "s0")] * 10 + [(5, f"w{k} " * (1 + k % 3), "s0") for k in range(6)] + [(7, "x y", "s1")] * 9 + [(k, "z " * 4, "s2") for k in range(5)] + [(None, None, "s3")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).withColumn("last", F.lit(1)).withColumn("place", F.lit("p"))
    df = cut(df, "test-mix")
    got = mixing.mix(df).select("source", "mix.*").collect()
    assert len(got) == len(rows)
    for s in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == s]
        assert sum(r["size"] for r in mine) == mine[0]["source_size"]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(r["size"] for r in mine) / 2 + 1e-6
        assert max(r["copies"] for r in mine) <= 2
    again = mixing.mix(df).select("source", "mix.*").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9), st.floats(0.1, 2))
@settings(max_examples=8, deadline=None)
def test_targets_are_feasible(spark, sizes, share):
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = {r["source"]: r for r in mixing.targets(df, [5, 2, 1], share, 2).collect()}
    want = plain_targets({s: r["source_size"] for s, r in got.items()}, {f"s{i}": (5, 2, 1)[i % 3] for i in range(len(sizes))}, share, 2)
    assert {s: r["target"] for s, r in got.items()} == pytest.approx(want, abs=1e-6)


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300)))
@settings(max_examples=100, deadline=None)
def test_coding_round_trip(numbers):
    control, data = token_files.encode(np.array(numbers, np.uint32))
    assert len(control) == -(-len(numbers) // 4)
    assert token_files.decode(control, data, len(numbers)).tolist() == numbers


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_pieces_give_what_whole_texts_give():
    plain, encoder = tokenizer(), pieces.Encoder(queries.tokenizer_path())
    assert encoder.apart and encoder.inner

    def split(texts):
        ids, n = encoder(texts)
        return np.split(ids, np.cumsum(n)[:-1]) if texts else []

    texts = [t for _, t, *_ in odd_documents() if t] + ["it's 'tis can't 'S\u2019s", "a\x0bb\x0cc\x1cd\x85e\u2028f", "ΣΑΣ Σ ςΣ", "I\u0307 İ x\u0301 \u0301y", "a<|endoftext|>b <|startoftext|>", "12345 1st 3.14 --- !!!", "\r\n\r\n", prose(3, 500).upper(), "a\x01b \x01 \x01\x01 c\x01"]
    texts += ['("ÀÉ")?!. ÉTÉ, été. ((x) (("y', "İ, Å; H\u0331, h\u0331! Ç\u0327. \u05d9\u05b4,", "<|STARTOFTEXT|> x<|startoftext|>.", "ª º µ ß ẞ ÿ Ÿ ×÷ a1, a.b a,b. 日本語. 가."]
    texts += ["x" * 3_000_000 + " end", "y " * 900_000 + "z", "'s's 'S it's's x's.y 's", "<<|x|>> <| <|> a<b", "É<|endoftext|>É 1<|startoftext|>", "Ãª Ã ã Ý×Ý÷ý Þß"]
    for _ in range(2):
        for t, ids in zip(texts, split([t.encode() for t in texts]), strict=True):
            assert ids.tolist() == [*plain.encode(t, add_special_tokens=False).ids, 1]
    assert [x.tolist() for x in split([None, b"", b" "])] == [[1]] * 3 and encoder([])[0].tolist() == []
    encoder.filled = pieces.POOL + 1
    assert [x.tolist() for x in split([b"one two"])] == [[*plain.encode("one two", add_special_tokens=False).ids, 1]]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_tokenizers_that_join_across_white_space_get_whole_texts(name):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(name)
    plain, encoder = Tokenizer.from_file(path), pieces.Encoder(path)
    assert not encoder.apart
    ids, n = encoder([b"The quick  brown\nfox", None, "déjà vu".encode()])
    want = [[*plain.encode(t, add_special_tokens=False).ids, 1] for t in ("The quick  brown\nfox", "", "déjà vu")]
    assert ids.tolist() == sum(want, []) and n.tolist() == [len(x) for x in want]


def test_token_files(spark, docs):
    path = new_path(spark, "test-tokens")
    token_files.write(docs, "doc_id", "text", queries.tokenizer_path(), path, new_path(spark, "test-work"), 50)
    got = token_files.read(spark, path).orderBy("start").collect()
    plain, at, want = tokenizer(), 0, []
    for i, t, *_ in sorted(odd_documents(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [(r["id"], r["start"], r["n_tokens"], zlib.crc32(bytes(r["tokens"]))) for r in got] == want


def test_token_files_of_no_rows(spark):
    path = new_path(spark, "test-tokens")
    token_files.write(spark.createDataFrame([], SCHEMA), "doc_id", "text", queries.tokenizer_path(), path, new_path(spark, "test-work"), 0)
    assert token_files.read(spark, path).count() == 0


def test_pipeline(spark):
    """Each stage against a plain version on its own input."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    stages, at = dict(corpus_pipeline.STAGES), docs

    def after(name):
        got = cut(stages[name](spark, at, sf), "test-stage")
        assert got.columns == docs.columns
        return got

    before, at = texts(at), after("quality rules")
    failed = {i for i, t in before.items() if (s := plain_statistics(t))[0] < 20 or 100 * s[4] > 30 * s[0]}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = texts(at)
    assert not failed & set(kept) and all(i in kept for i, q in labels.items() if q == 1 and i in before and i not in failed)

    before, at = kept, after("near duplicates")
    label, _ = plain_components(before, 5, 80)
    assert set(texts(at)) == {i for i in before if label[i] == i}

    before, at = texts(at), after("benchmark leaks")
    sets = lambda t: shingle_set(t, 5) if len(words(t)) >= 5 else set()
    items = [s for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if (s := sets(r["text"]))]
    leaky = {i for i, t in before.items() if any(100 * len(s & sets(t)) >= 80 * len(s) for s in items)}
    assert set(texts(at)) == set(before) - leaky

    source, before = {r["doc_id"]: r["source"] for r in at.collect()}, texts(at)
    at = after("mix")
    copies, size = Counter(r["doc_id"] for r in at.collect()), Counter()
    for i, t in before.items():
        size[source[i]] += len(words(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = plain_targets(size, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5, 2)
    for s in size:
        mine = [i for i in before if source[i] == s]
        assert abs(sum(copies[i] * len(words(before[i])) for i in mine) - want[s]) <= max(len(words(before[i])) for i in mine) / 2 + 1e-6
    assert max(copies.values()) <= 2

    plain, place, tokens = tokenizer(), 0, []
    for i in sorted(copies.elements()):
        ids = [*plain.encode(before[i] or "", add_special_tokens=False).ids, 1]
        tokens.append((i, place, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        place += len(ids)
    assert sorted(map(tuple, stages["token files"](spark, at, sf).collect())) == tokens
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == tokens


def test_pipeline_of_no_rows_and_of_nulls(spark):
    docs = spark.createDataFrame([], SCHEMA)
    odd = cut(spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", None, 0), (3, prose(1, 80), "en", "s", 9), (3, prose(1, 80), "en", "s", 9)], SCHEMA), "test-docs")
    for start in (docs, odd):
        at = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            at = cut(stage(spark, at, "/root/testdata/sf0.001"), "test-stage")
            assert at.columns == docs.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, at, "/root/testdata/sf0.001").count() == at.count()
