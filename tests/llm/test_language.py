"""Language identification: paths against a plain Viterbi, grams against plain cutting, accuracy on rows that it didn't learn from."""

import random
import zlib
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import language, queries
from quire.llm.scratch import cut
from tests.llm.helpers import SCHEMA, odd_documents, prose

SYLLABLES = {"en": ["th", "ing", "and", "wh", "ou", "er", "ly"], "de": ["sch", "ein", "ü", "ung", "keit", "zu", "ver"], "ru": ["при", "вет", "ск", "ый", "ние", "да"], "el": ["και", "ος", "ων", "θα", "της"], "bg": ["ът", "ите", "ще", "зъ", "щия"]}


def speech(lang, seed, n):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def taught(spark):
    rows = [(i, speech(g, i, 30), g) for g in SYLLABLES for i in range(40)]
    rows += [(900, None, "xx"), (901, "123 !", "xx"), (902, speech("en", 5, 5), None)]
    return language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def plain_path(scores, penalty):
    """The best path by trying, at each word, every language after every other."""

    @cache
    def best(t, g):
        if t == 0:
            return float(scores[0][g]), None
        stay = best(t - 1, g)[0]
        top = max(range(len(scores[0])), key=lambda k: (best(t - 1, k)[0], -k))
        moved = best(t - 1, top)[0] - penalty
        return (moved + scores[t][g], top) if stay < moved else (stay + scores[t][g], g)

    if not len(scores):
        return []
    path = [max(range(len(scores[0])), key=lambda k: (best(len(scores) - 1, k)[0], -k))]
    for t in range(len(scores) - 1, 0, -1):
        path.append(best(t, path[-1])[1])
    return path[::-1]


@pytest.mark.parametrize("seed", range(6))
def test_viterbi(seed):
    r = np.random.default_rng(seed)
    n = r.integers(0, 60, 20)
    n[r.integers(0, 20, 3)] = 0
    scores = r.integers(-8, 0, (n.sum(), 4)).astype(np.float32)
    scores[r.random(scores.shape) < 0.1] = -np.inf
    scores[np.isinf(scores).all(axis=1)] = 0
    offsets = np.concatenate(([0], np.cumsum(n)))
    got = language.viterbi(scores, offsets, 5.0)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        assert got[a:b].tolist() == plain_path(scores[a:b], 5.0)


def test_words_and_grams():
    texts = ["Ab c", None, "", "é漢字 12 x1y", "́ ñ̃o"]
    w = language.Words(texts)
    found = ["".join(chr(c) for c in w.code[a:b]) for a, b in zip(w.start, w.end, strict=True)]
    assert found == ["ab", "c", "é漢字", "x", "y", "ñ̃o"]
    assert np.diff(w.offsets).tolist() == [2, 0, 0, 3, 1] and w.letters.tolist() == [2, 1, 3, 1, 1, 2]
    assert [language.NAMES[s] for s in w.script] == ["latin"] * 6
    kinds = []
    for word in found:
        spelled = f" {word} "
        kinds.append([spelled[max(0, e - language.ORDERS[-1] + 1) : e + 1] for e in range(1, len(spelled))])
    last = list(w.grams())[-1]
    assert len(last) == sum(map(len, kinds))
    flat = [k for ks in kinds for k in ks]
    assert len({(k, h) for k, h in zip(flat, last.tolist(), strict=True)}) == len(set(flat))
    alone = {k: h for k, h in zip([k for k in flat], last.tolist(), strict=True)}
    again = list(language.Words(["c"]).grams())[-1].tolist()
    assert again == [alone[" c"], alone[" c "]]


def test_languages_scripts_and_mixed_texts(spark, taught):
    assert taught.langs == ["bg", "de", "el", "en", "ru", "xx"]
    en, de, ru = speech("en", 1000, 40), speech("de", 1000, 25), speech("ru", 1000, 50)
    rows = [(1, en), (2, speech("el", 77, 3)), (3, f"{en}. {de}, {ru}"), (4, None), (5, "12 ... !"), (6, ""), (7, ru + " " + en.split()[0] + " " + ru), (8, "漢字"), (9, en), (9, en)]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string"), taught)
    assert got.columns == ["doc_id", "text", "language"]
    by = {r["doc_id"]: r["language"] for r in got.collect()}
    assert got.count() == len(rows)
    assert by[1]["lang"] == "en" and by[1]["score"] == 1 and [tuple(s) for s in by[1]["spans"]] == [(0, len(en), "en")]
    assert by[2]["lang"] == "el"
    spans = [tuple(s) for s in by[3]["spans"]]
    assert spans == [(0, len(en), "en"), (len(en) + 2, len(en) + 2 + len(de), "de"), (len(en) + len(de) + 4, len(rows[2][1]), "ru")]
    assert by[3]["lang"] == "ru" and 0.3 < by[3]["score"] < 0.8
    for i in (4, 5, 6):
        assert tuple(by[i]) == ("und", 0.0, [])
    assert by[7]["lang"] == "ru" and len(by[7]["spans"]) in (1, 3)
    assert by[8]["lang"] in taught.langs and by[8]["score"] == 1


def test_odd_tables(spark, taught):
    docs = cut(spark.createDataFrame(odd_documents(), SCHEMA), "test-docs")
    got = language.identify(docs.withColumn("language", F.lit(1)).withColumn("a b", F.lit("x")), taught)
    assert got.columns == [*docs.columns, "a b", "language"] and got.count() == len(odd_documents())
    assert {r["language"]["lang"] for r in got.where("text IS NULL OR trim(text) = ''").collect()} == {"und"}
    assert language.identify(docs.limit(0), taught).count() == 0
    none = language.fit(docs.limit(0))
    assert none.langs == [] and {r["language"]["lang"] for r in language.identify(docs, none).collect()} == {"und"}
    one = language.fit(docs)
    assert {r["language"]["lang"] for r in language.identify(docs, one).collect()} == {"en", "und"}
    long = spark.createDataFrame([(1, prose(1, 200_000)), (2, "x" * 1_000_000)], "doc_id long, text string")
    assert [r["language"]["lang"] for r in language.identify(long, one, keep=["doc_id"]).collect()] == ["en", "en"]


def test_fit_reads_about_so_many_rows_of_each_language(spark):
    rows = [(i, speech("en", i, 4), "en") for i in range(900)] + [(i, speech("de", i, 4), "de") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a, b = language.fit(docs, rows=100), language.fit(docs.orderBy(F.desc("text")), rows=100)
    assert np.array_equal(a.logs, b.logs)
    assert not np.array_equal(a.logs, language.fit(docs, rows=1000).logs)


def test_query_on_rows_that_it_did_not_learn_from(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op13_language_id(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    right = []
    for d in docs:
        r = got[d["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in d["text"] or ""):
            assert r["lang_pred"] == "und"
        elif r["held_out"]:
            right.append(r["lang_pred"] == d["lang"])
    assert sum(right) / len(right) > 0.98
