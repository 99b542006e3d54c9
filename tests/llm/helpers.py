"""Small documents with every odd case, and plain versions of what the operators do."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return (text or "").encode().lower().decode()


def words(text):
    return WORD.findall(text or "")


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    names = ["".join(r.choice("aeioubdgklmnrst") for _ in range(r.randint(2, 7))) for _ in range(vocabulary)]
    out = []
    for i in range(n):
        out.append(r.choice(names) + ("." if i % 11 == 10 else ""))
        out.append("\n" if i % 13 == 12 else " ")
    return "".join(out).strip()


def odd_documents():
    """(doc_id, text, lang, source, n_chars): nulls, blanks, ties, repeated rows, long and odd texts, near and exact copies."""
    base = [prose(i, 60 + 7 * i) for i in range(12)]
    rows = list(enumerate(base))
    rows += [(20, base[3]), (21, base[3]), (22, base[3].replace(" ", "  ").upper()), (23, base[5] + " and a few more words"), (24, base[6][10:])]
    rows += [(30, None), (31, ""), (32, " \n\t "), (33, "one"), (34, "One"), (35, "two words"), (36, "ß Straße ñandú \u00a0x\u2003y 漢字 😀 e\u0301"), (37, prose(99, 9000)), (38, "same line\n" * 40)]
    rows += [(40, "x" * 5000), (41, base[2] + "\n" + base[7]), (42, base[7] + "\n\n\n\n\n\n" + base[2])]
    made = [(i, t, "en", None if i in (4, 31) else f"s{i % 4}", None if t is None else len(t)) for i, t in rows]
    return made + [made[8], (None, base[9], "en", "s1", 1), (None, None, None, None, None)]


def rows_of(df, key="doc_id"):
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: (r[key] is None, r[key], repr(sorted(r.items(), key=lambda x: x[0]))))
