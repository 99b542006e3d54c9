"""Language model, boosted trees, URL reputation and chat roles."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import chat, katz, quality, url_filter
from quire.llm.boosting import train
from quire.llm.scratch import cut
from tests.llm.helpers import SCHEMA, lower, odd_documents, rows_of, words


@pytest.fixture(scope="module")
def docs(spark):
    return cut(spark.createDataFrame(odd_documents(), SCHEMA), "test-docs")


def plain_good_turing(counts):
    """Discounts of things seen 1 to 5 times, from how often each thing was seen."""
    n = Counter(counts.values())
    spare = 6 * n[6] / n[1] if n[1] else 1
    out = {}
    for r in range(1, 6):
        d = ((r + 1) * n[r + 1] / n[r] / r - spare) / (1 - spare) if n[r] and spare != 1 else 0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


class PlainKatz:
    def __init__(self, token_lists):
        self.c = Counter(w for t in token_lists for w in t)
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.pairs = Counter(p for t in token_lists for p in zip(["<s>", *t[:-1]], t, strict=True))
        self.d1, self.d2 = ({**plain_good_turing(c), 6: 1.0} for c in (self.c, self.pairs))
        top = 6
        freed = sum((1 - self.d1[min(x, top)]) * x for x in self.c.values())
        self.size = self.n if freed else self.n + 1
        self.unknown = (freed or 1) / self.size
        self.total, self.freed, self.mass = Counter(), Counter(), Counter()
        for (v, w), x in self.pairs.items():
            self.total[v] += x
            self.freed[v] += (1 - self.d2[min(x, top)]) * x
            self.mass[v] += self.p1(w)

    def p1(self, w):
        c = self.c[w]
        return self.d1[min(c, 6)] * c / self.size if c else self.unknown

    def p2(self, v, w):
        if not self.total[v]:
            return self.p1(w)
        size = self.total[v] + (self.freed[v] <= 0)
        x = self.pairs[v, w]
        if x:
            return self.d2[min(x, 6)] * x / size
        return (self.freed[v] if self.freed[v] > 0 else 1) / size / (1 - self.mass[v]) * self.p1(w)


def test_katz_scores(docs):
    rows = odd_documents()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = [[*words(lower(t)), None] for _, t, *_ in rows]
    plain = PlainKatz([t for t, (i, *_) in zip(tokens, rows, strict=True) if not held(i)])
    for v in ("<s>", *list(plain.c)[:3]):
        assert sum(plain.p2(v, w) for w in plain.c) + plain.p2(v, object()) == pytest.approx(1)
    want = []
    for (i, *_), t in zip(rows, tokens, strict=True):
        base = sum(math.log10((plain.c[w] + 1) / (plain.n + plain.v + 1)) for w in t)
        score = sum(math.log10(plain.p2(v, w)) for v, w in zip(["<s>", *t[:-1]], t, strict=True))
        want.append((repr(i), held(i), len(t), sum(plain.c[w] > 0 for w in t), plain.n, base, score))
    got = [(repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in katz.train_and_score(docs).scores.collect()]
    for g, w in zip(sorted(got), sorted(want), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_katz_tables(docs):
    made = katz.train_and_score(docs)
    total = sum(katz.unpack(r["counts"]).sum() for r in made.unigrams.collect())
    pairs = sum(katz.unpack(r["counts"]).sum() for r in made.bigrams.collect())
    assert total == pairs == made.scores.first()["train_tokens"]


def test_katz_deals_frequent_first_words_to_several_buckets(spark, docs):
    want, made = katz.train_and_score(docs), katz.train_and_score(docs, spread=20)
    buckets = Counter(f for r in made.bigrams.collect() for f in set(katz.unpack(r["firsts"]).tolist()))
    assert buckets[katz.START] > 1 and max(buckets.values()) > 2 and min(buckets.values()) == 1
    assert sum(katz.unpack(r["counts"]).sum() for r in made.bigrams.collect()) == want.scores.first()["train_tokens"]
    for g, w in zip(rows_of(made.scores), rows_of(want.scores), strict=True):
        assert [g[c] for c in ("doc_id", "held_out", "n_tokens", "n_known")] == [w[c] for c in ("doc_id", "held_out", "n_tokens", "n_known")]
        assert (g["base_score"], g["score"]) == pytest.approx((w["base_score"], w["score"]), rel=1e-9)


def test_katz_without_rows_or_training(spark):
    assert katz.train_and_score(spark.createDataFrame([], SCHEMA)).scores.count() == 0
    i = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = katz.train_and_score(spark.createDataFrame([(i, "a b", "en", "s", 3)], SCHEMA)).scores.first()
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (True, 3, 0, 0, 0.0, 0.0)


def test_good_turing_falls_back():
    assert katz.good_turing([0] * 6)[1:6].tolist() == [(r - 0.5) / r for r in range(1, 6)]
    d = katz.good_turing([1000, 300, 150, 90, 60, 42])
    assert all(0 < x < 1 for x in d[1:6]) and d[6] == 1


def plain_statistics(t):
    w, seen, dup = words(t), set(), 0
    for line in (t or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    g = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    repeat = {k + o for k in range(len(w) - 7) if g[tuple(w[k : k + 8])] > 1 for o in range(8)}
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), dup, len(repeat)


def test_quality_statistics(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(None, 1, 0), (3, None, None), (5, 0, 1)], "doc_id long, quality int, toxic int")
    forest = quality.fit(docs, labels)
    got = quality.judge(docs, forest)
    want = sorted((repr(i), plain_statistics(t)) for i, t, *_ in odd_documents())
    rows = got.collect()
    assert sorted((repr(r["doc_id"]), tuple(r["quality"][c] for c in quality.BASE)) for r in rows) == want
    for r in rows:
        q = r["quality"]
        assert q["base_failed"] == (q["n_words"] < 20 or 100 * q["n_repeat_words"] > 30 * q["n_words"])
        assert not (q["base_failed"] and q["kept"])
    kept = quality.keep_good(docs.withColumn("quality", F.lit("mine")), labels)
    assert kept.columns == [*docs.columns, "quality"] and {r["quality"] for r in kept.collect()} == {"mine"}
    assert quality.keep_good(docs.limit(0), labels.limit(0)).count() == 0


def test_trees_learn_and_keep_their_constraints():
    r = np.random.default_rng(3)
    x = r.uniform(-1, 1, (3000, 3))
    y = ((x[:, 0] - 0.6 * x[:, 1] + 0.2 * np.sin(9 * x[:, 0]) + r.normal(0, 0.3, 3000)) > 0).astype(float)
    forest = train(x[:2000], y[:2000], np.array([1.0, -1.0, 0.0]))
    assert ((forest.score(x[2000:]) > 0) == y[2000:]).mean() > 0.85
    for j, sign in ((0, 1), (1, -1)):
        z = np.repeat(x[:50], 60, axis=0)
        z[:, j] = np.tile(np.linspace(-1, 1, 60), 50)
        assert (sign * np.diff(forest.score(z).reshape(50, 60), axis=1) >= -1e-12).all()


def plain_tree_score(forest, row):
    total = forest.bias
    for f, t, v in zip(forest.feature, forest.threshold, forest.value, strict=True):
        i = 0
        while f[i] >= 0:
            i = 2 * i + 1 + (row[f[i]] > t[i])
        total += v[i]
    return total


def test_flat_trees_score_like_a_walk():
    r = np.random.default_rng(4)
    x, y = r.uniform(size=(400, 4)), r.integers(0, 2, 400).astype(float)
    forest = train(x, y, np.zeros(4), trees=7)
    assert forest.score(x[:50]) == pytest.approx([plain_tree_score(forest, row) for row in x[:50]])
    assert train(x[:0], y[:0], np.zeros(4)).score(x[:2]).tolist() == [20.0, 20.0]


def test_documents_are_kept_as_a_walk_down_the_trees_says(spark):
    """Short shouted texts are bad, prose is good; rows that share an id have different texts."""
    r = random.Random(9)
    rows = [(i, " ".join(r.choice(["WORD", "NO!!", "##"] if i % 3 == 0 else ["word", "some", "and", "more", "of", "it."]) + str(r.randint(0, 99)) for _ in range(40)), "en", "s", 1) for i in range(240)]
    rows += [(i, "another text " * 30, "en", "s", 1) for i in range(0, 240, 7)] + [(999, None, "en", "s", 0), (998, "", "en", "s", 0)]
    docs = cut(spark.createDataFrame(rows, SCHEMA), "test-docs")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    forest, again = quality.fit(docs, labels), quality.fit(docs, labels)
    assert (forest.feature == again.feature).all() and (forest.threshold == again.threshold).all() and (forest.value == again.value).all()
    got = quality.judge(docs, forest).select("text", "quality.*").collect()
    base, x = quality.statistics([g["text"] for g in got])
    for k, g in enumerate(got):
        n, _, _, _, repeat = plain_statistics(g["text"])
        p = 1 / (1 + math.exp(-plain_tree_score(forest, x[k])))
        failed = n < 20 or 100 * repeat > 30 * n
        assert g["probability"] == pytest.approx(p) and (g["base_failed"], g["kept"]) == (failed, not failed and p >= 0.1)
    # held out: ids from 200 on
    kept = {row["doc_id"] for row in quality.judge(docs, forest).where("quality.kept AND doc_id BETWEEN 200 AND 239").collect()}
    assert kept == {i for i in range(200, 240) if i % 3}


URLS = [
    ("http://A.Example.NET/en/1?x=/", "a.example.net", "/en/1", "example.net/en/", "allow"), ("https://example.net/fr/", "example.net", "/fr/", "net/", "block"),
    ("x://example.com/de/?q", "example.com", "/de/", "example.com/de/", "block"), ("x://notexample.com/de/", "notexample.com", "/de/", None, "allow"), ("x://www.a.org/fr/b#c", "www.a.org", "/fr/b", "org/fr/", "allow"),
    ("no host", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"), ("s://h.net", "h.net", "", None, "allow"), ("s://h?://x/y", "h", "", None, "allow"), ("s://h\nx/p\nq", "h\nx", "/p\nq", None, "allow"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "z") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "page_id long, bad long")
    for r in url_filter.filter_urls(pages, none).collect():
        q = r["reputation"]
        assert (q["host"], q["path"], q["rule"], q["verdict"]) == URLS[r["page_id"]][1:] and r["host"] == "z"


def test_hosts_are_shrunk_and_judged(spark):
    rows = []
    for host, bad, n in (("bad.spam.com", 95, 100), ("few.spam.com", 1, 1), ("good.fine.com", 3, 200), ("few.fine.com", 1, 1), ("solo.io", 1, 1)):
        rows += [(len(rows) + k, f"http://{host}/{k}", int(k < bad)) for k in range(n)]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    judged = spark.createDataFrame([(r[0], r[2]) for r in rows], "page_id long, bad long")
    known = spark.createDataFrame([(u.split("/")[2], b) for _, u, b in rows], "host string, bad long")
    mean = {r["host"]: r["mean"] for r in url_filter.reputation(known).collect()}
    assert mean["bad.spam.com"] > 0.9 and mean["few.spam.com"] > 0.5 > mean["few.fine.com"] > mean["good.fine.com"]
    verdict = {r["h"]: r["v"] for r in url_filter.filter_urls(pages, judged).selectExpr("reputation.host h", "reputation.verdict v").distinct().collect()}
    assert verdict["bad.spam.com"] == "block" and verdict["good.fine.com"] == "allow"


def test_hosts_without_labels_are_judged_by_domain_and_suffix(spark):
    rows = []
    for host, bad, n in (("bad.spam.com", 95, 100), ("bad2.spam.com", 48, 50), ("good.fine.com", 3, 200), ("a.gov.uk", 60, 60), ("b.gov.uk", 0, 60)):
        rows += [(len(rows) + k, f"http://{host}/{k}", int(k < bad)) for k in range(n)]
    unseen = {"new.spam.com": "block", "new.fine.com": "allow", "x.a.gov.uk": "block", "x.b.gov.uk": "allow"}
    pages = spark.createDataFrame([r[:2] for r in rows] + [(1000 + k, f"http://{h}/") for k, h in enumerate([*unseen, "other.com", "other.zz"])], "page_id long, url string")
    judged = spark.createDataFrame([(r[0], r[2]) for r in rows], "page_id long, bad long")
    got = {r["h"]: (r["v"], r["b"]) for r in url_filter.filter_urls(pages, judged).selectExpr("reputation.host h", "reputation.verdict v", "reputation.bad_bound b").distinct().collect()}
    assert {h: got[h][0] for h in unseen} == unseen
    assert all(b is not None for _, b in got.values())


def test_pages_with_nulls_and_repeats(spark):
    rows = [(None, "http://a.b.com/"), (1, "http://a.b.com/x"), (1, "http://a.b.com/x"), (2, None), (None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("bad", F.lit("mine"))
    judged = spark.createDataFrame([(1, 1), (2, 0)], "page_id long, bad long")
    got = url_filter.filter_urls(pages, judged)
    assert got.columns == [*pages.columns, "reputation"] and got.count() == len(rows) and {r["bad"] for r in got.collect()} == {"mine"}
    assert url_filter.filter_urls(pages.limit(0), judged).count() == 0 and url_filter.filter_urls(pages, judged.limit(0)).where("reputation.verdict = 'allow'").count() == len(rows)


def test_registered_domains(spark):
    hosts = {"a.b.gov.uk": ("b.gov.uk", "gov.uk"), "x.com.cn": ("x.com.cn", "com.cn"), "a.b.co.uk": ("b.co.uk", "co.uk"), "a.com.org": ("com.org", "org"), "q.r.de": ("r.de", "de"), "": ("", ""), "x.y.de:8080": ("y.de", "de"), "10.0.0.1": ("10.0.0.1", "10.0.0.1"), "10.0.0.1:80": ("10.0.0.1", "10.0.0.1"), "[::1]:8": ("[::1]", "[::1]")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert {r[0]: tuple(r[1:]) for r in df.select("host", *url_filter.domain_of(F.col("host"))).collect()} == hosts


def test_outcomes(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 0), (3, 1, 1), (None, 0, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    assert {r["page_id"]: r["bad"] for r in url_filter.outcomes(labels).collect()} == {1: 1, 2: 0, 3: 1, 4: 0}


def chats(seed, n, turns=8):
    """User messages are short and ask, the assistant's are long."""
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(turns):
            role = "user" if t % 2 == 0 else "assistant"
            text = " ".join("word" for _ in range(r.randint(3, 7))) + "?" if role == "user" else "\n".join(" ".join("word" for _ in range(r.randint(30, 60))) for _ in range(r.randint(1, 3)))
            rows.append((c, t, role, text))
    return rows


SCHEMA_CHAT = "conv_id long, turn long, role string, text string"


def test_hidden_roles_are_recovered(spark):
    rows = chats(1, 40)
    r = random.Random(2)
    hidden = [(c, t, None if r.random() < 0.3 else role, text) for c, t, role, text in rows]
    got = chat.parse_chats(spark.createDataFrame(hidden, SCHEMA_CHAT)).collect()
    role = {(x["conv_id"], x["turn"]): x["role"] for x in got if x["part"] == 0}
    lost = [(c, t) for c, t, s, _ in hidden if s is None]
    truth = {(c, t): role_ for c, t, role_, _ in rows}
    assert sum(role[k] == truth[k] for k in lost) > 0.95 * len(lost)
    assert all(role[c, t] == s for c, t, s, _ in hidden if s)


def test_blocks_give_what_one_pass_gives():
    r = np.random.default_rng(5)
    steps, e, fresh = np.log(r.dirichlet(np.ones(3), (2, 4))), np.log(r.uniform(0.01, 1, (57, 3))), r.integers(0, 2, 57)
    best, back = steps[fresh[0], 3] + e[0], []
    for row, f in zip(e[1:], fresh[1:], strict=True):
        way = best[:, None] + steps[f, :3]
        back.append(way.argmax(axis=0))
        best = way.max(axis=0) + row
    want = [int(best.argmax())]
    for b in back[::-1]:
        want.append(int(b[want[-1]]))
    want = want[::-1]
    cuts, enter, got = [0, 10, 11, 40, 57], 3, []
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        chance = sum(e[k, want[k]] + steps[fresh[k], 3 if k == 0 else want[k - 1], want[k]] for k in range(i, j))
        assert chat.block_matrix(e[i:j], fresh[i:j], steps)[enter, want[j - 1]] == pytest.approx(chance)
        got += chat.decode(e[i:j], fresh[i:j], steps, enter, want[j - 1]).tolist()
        enter = want[j - 1]
    assert got == want


def test_chat_oddities(spark):
    rows = [*chats(7, 3), (50, 0, "User", "a\nAssistant: b\nc"), (50, 1, None, None), (50, 1, None, None), (50, None, "tool", ""), (None, 3, "system", "be kind"), (51, 0, "ai", "x" * 20000)]
    rows += [(60, t, "user" if t % 2 == 0 else "assistant", f"m {t}") for t in range(700)]
    df = spark.createDataFrame(rows, SCHEMA_CHAT).withColumn("k", F.lit(1)).withColumn("msg", F.lit("x"))
    got = chat.parse_chats(df).collect()
    assert len(got) == len(rows) + 1
    one = [(r["part"], r["role"], r["rendered"]) for r in rows_of(chat.parse_chats(df).where("conv_id = 50 AND turn = 0"), "part")]
    assert one == [(0, "user", "<|user|>\na\n<|end|>"), (1, "assistant", "<|assistant|>\nb\nc\n<|end|>")]
    long = sorted((r["turn"], r["role"]) for r in got if r["conv_id"] == 60)
    assert long == [(t, "user" if t % 2 == 0 else "assistant") for t in range(700)]
    assert [r["role"] for r in got if r["conv_id"] is None] == ["system"]
    assert chat.parse_chats(df.limit(0)).count() == 0


def test_repeated_messages_of_several_lines(spark):
    rows = [*chats(7, 3), *[(70, 0, "user", "a\nb\nc")] * 3, *[(70, 1, None, "User: d\ne")] * 2, *[(None, None, "assistant", "f\ng")] * 2]
    got = rows_of(chat.parse_chats(spark.createDataFrame(rows, SCHEMA_CHAT)).where("conv_id = 70 OR conv_id IS NULL"), "part")
    told = {t: [(r["part"], r["n_lines"], r["rendered"]) for r in got if r["turn"] == t] for t in (0, 1, None)}
    assert told[0] == [(k, 3, "<|user|>\na\nb\nc\n<|end|>") for k in range(3)]
    assert told[1] == [(k, 2, "<|user|>\nd\ne\n<|end|>") for k in range(2)]
    assert told[None] == [(k, 2, "<|assistant|>\nf\ng\n<|end|>") for k in range(2)]
    lines = cut(chat.transcript_lines(spark.createDataFrame(rows[24:], SCHEMA_CHAT), "conv_id", "turn", "role", "text"), "test-lines")
    steps, _ = chat.estimate(lines)
    # 3 copies with two inner lines each, of a user
    assert np.exp(steps[0, 1]) == pytest.approx(np.array([1, 1 + chat.STAY + 6, 1]) / (chat.STAY + 9))


class PlainChat:
    """The same model, counted and decoded message by message in plain Python."""

    def __init__(self, rows):
        self.rows = [(c, t, chat.SPEAKERS.get((r or "").strip().lower(), -1), (x or "").split("\n")) for c, t, r, x in rows]
        n, stay, wrong = 3, chat.STAY, chat.WRONG
        self.step = [[[1.0 + (stay if f == 0 and a == b else 0) for b in range(n)] for a in range(n + 1)] for f in (0, 1)]
        self.mark = [[[1.0 if m == s else (1.0 if f else stay) if m == n else wrong for m in range(n + 1)] for s in range(n)] for f in (0, 1)]
        self.ask, self.long = [[1.0] * 2 for _ in range(n)], [[1.0] * 4 for _ in range(n)]
        last = {}
        for c, _, s, lines in self.rows:
            before, last[c] = last.get(c, n), s
            if s >= 0 and before >= 0:
                self.step[1][before][s] += 1
            for k, line in enumerate(lines):
                m, asks, long = self.features(line)
                if s >= 0 and k == 0:
                    self.mark[1][s][m], self.ask[s][asks], self.long[s][long] = self.mark[1][s][m] + 1, self.ask[s][asks] + 1, self.long[s][long] + 1
                elif s >= 0:
                    now = s if m == n else m
                    self.mark[0][now][m] += 1
                    self.step[0][s][now] += 1

    @staticmethod
    def features(line):
        m = re.match(chat.MARKER, line)
        long = sum(len(words(line)) > x for x in chat.LENGTHS)
        return chat.SPEAKERS[m[1].lower()] if m else 3, int(re.search(r"\?\s*$", line) is not None), long

    def decode(self):
        p = lambda counts, i: math.log(counts[i] / sum(counts))
        out, at = [], {}
        for c, t, s, lines in self.rows:
            best = at.setdefault(c, [[0.0 if a == 3 else -math.inf, []] for a in range(4)])
            for k, line in enumerate(lines):
                m, asks, long = self.features(line)
                fresh, new = int(k == 0), []
                for b in range(3):
                    e = p(self.mark[fresh][b], m) + p(self.ask[b], asks) + p(self.long[b], long)
                    e += math.log(1 - chat.WRONG if b == s else chat.WRONG / 2) if fresh and s >= 0 else 0
                    a = max(range(len(best)), key=lambda a: best[a][0] + p(self.step[fresh][a], b))
                    new.append([best[a][0] + p(self.step[fresh][a], b) + e, [*best[a][1], (t, k, line, b, m)]])
                best = at[c] = new
        for c, best in at.items():
            part, before = 0, None
            for t, k, line, b, m in max(best, key=lambda x: x[0])[1]:
                if before is None or t != before[0] or k == 0 or m < 3 or b != before[1]:
                    part = 0 if before is None or t != before[0] else part + 1
                    out.append([c, t, part, chat.ROLES[b], []])
                out[-1][4].append(re.sub(chat.MARKER, "", line, count=1) if m < 3 else line)
                before = (t, b)
        return [(c, t, part, role, len(x), f"<|{role}|>\n" + "\n".join(x) + "\n<|end|>") for c, t, part, role, x in out]


@pytest.mark.parametrize("seed", range(2))
def test_chats_as_a_plain_parser_has_them(spark, seed, monkeypatch):
    r = random.Random(seed)
    rows = []
    for c in [None, *range(12)]:
        for t in sorted(r.sample(range(90), r.randint(1, 8)) if c else range(60)):
            role = r.choice(["user", "Assistant ", "system", "human", None, "tool"])
            text = "\n".join(r.choice(["", "User: ", "[assistant]: ", "# system> ", ""]) + " ".join(["word"] * r.randint(0, 50)) + r.choice(["", "?"]) for _ in range(r.randint(1, 5)))
            rows.append((c, None if t == 0 and c else t, role, r.choice([text, text, text, None])))
    rows += [(99, 0, "user", "\n".join(["a line", "AI: and more", "?"] * 900))] * (seed + 1)
    monkeypatch.setattr(chat, "BLOCK_LINES", 16)
    want = PlainChat(sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] is not None, x[1] or 0))).decode()
    got = chat.parse_chats(spark.createDataFrame(rows, SCHEMA_CHAT).repartition(5)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_one_conversation_alone(spark):
    got = chat.parse_chats(spark.createDataFrame([(1, 0, "user", "hi?"), (1, 1, None, "Bot: yes\nmore")], SCHEMA_CHAT)).collect()
    assert [(r["turn"], r["role"], r["n_lines"], r["rendered"]) for r in sorted(got)] == [(0, "user", 1, "<|user|>\nhi?\n<|end|>"), (1, "assistant", 2, "<|assistant|>\nyes\nmore\n<|end|>")]


def test_groups_come_whole_from_any_batches():
    import pandas as pd

    keys = [0] * 3 + [1] + [2] * 7 + [3, 4, 4, 5]
    for size in range(1, 17):
        pdf = pd.DataFrame({"key": keys, "x": range(len(keys))})
        got = [c["x"][i:j].tolist() for c, groups in chat.whole_groups(iter([pdf.iloc[i : i + size] for i in range(0, len(keys), size)]), ["key"]) for i, j in groups]
        assert got == [[x for x, k in enumerate(keys) if k == g] for g in range(6)]
    assert list(chat.whole_groups(iter([pdf.iloc[:0]]), ["key"])) == []


def test_many_messages_of_one_turn_are_spread(spark):
    rows = [(80, 3, "user", f"ask {k}?") for k in range(900)] + [(80, 4, "assistant", f"say {k}\nmore") for k in range(900)] + [(None, None, "user", "same")] * 700 + [(81, 0, "user", "a"), (81, 1, None, "b"), (81, 5, "assistant", "c"), (81, 7, "user", "d")]
    df = spark.createDataFrame(rows, SCHEMA_CHAT)
    lines = cut(chat.transcript_lines(df, "conv_id", "turn", "role", "text"), "test-lines")
    blocks = [r["n"] for r in lines.where("k = 0").groupBy("conv", "block").count().withColumnRenamed("count", "n").collect()]
    assert sum(blocks) == len(rows) and max(blocks) <= chat.BLOCK_LINES
    # pairs of neighbours, not of all messages at neighbouring turns; none over the message without a role
    n = {(r["before"], r["state"]): r["n"] for r in chat.transitions(lines).collect()}
    assert n == {(chat.START, 1): 3, (1, 1): 899 + 699, (1, 2): 1, (2, 2): 899, (2, 1): 1}
    got = chat.parse_chats(df).collect()
    for c, t, role, size, count in ((80, 3, "user", 1, 900), (80, 4, "assistant", 2, 900), (None, None, "user", 1, 700)):
        mine = [r for r in got if (r["conv_id"], r["turn"]) == (c, t)]
        assert sorted(r["part"] for r in mine) == list(range(count)) and {(r["role"], r["n_lines"]) for r in mine} == {(role, size)}
    assert len({r["rendered"] for r in got if r["turn"] == 3}) == 900
