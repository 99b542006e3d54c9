"""Token ids of texts by a tokenizers file, each distinct piece of text encoded about once.

Texts are cut into units in numpy: where the tokenizer allows it (this is tried on every character concerned), runs of
letters, digits and runs of other signs, in lower case; pieces between ASCII white space that hold anything else stay
whole. Units are looked up by a 64-bit fingerprint in a table of fixed size; the library encodes those not found.
"""

from __future__ import annotations

import os
import string
from functools import cache
from itertools import chain

import numpy as np

from quire.llm.words import byte_table, mix, powers

END_ID = 1
#: Places in the table of known units (a new unit takes the place of the old one), and ids that it holds before it starts afresh.
SLOTS, POOL = 1 << 21, 8_000_000
#: Bytes cut into units at once, unless a single piece is longer.
CHUNK = 1 << 20
#: What stands between units that are encoded in one row, units in a row, and rows that the library is given at once.
MARK, ROW, ROWS = "\x01", 500, 20
SPACE, LETTER, DIGIT, SIGN, OTHER = range(5)
LATIN = "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    for name, kind in ((" \t\n\r\x0b\x0c", SPACE), (string.ascii_letters, LETTER), (string.digits, DIGIT), (string.punctuation, SIGN)):
        out[list(name.encode())] = kind
    return out


CLASS = _classes()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def cut_units(data: np.ndarray, inner: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, the bytes that name them, which bytes are of letters) of the units of UTF-8 bytes that end with white space.

    Without ``inner`` units are the pieces between white space. With it, pieces of ASCII and Latin-1 letters, digits and
    signs are cut further and put in lower case, unless an apostrophe or a < in them may begin something longer.
    """
    kind = CLASS[data]
    said = kind != SPACE
    begins = said.copy()
    begins[1:] &= ~said[:-1]
    ends = said[:-1] & ~said[1:]
    if not inner:
        return np.flatnonzero(begins), np.flatnonzero(ends) + 1, data, np.zeros(len(data), bool)
    named = LOWER[data]
    two = np.flatnonzero(data == 0xC3)
    two = two[(data[two + 1] != 0x97) & (data[two + 1] != 0xB7)]
    kind[two] = kind[two + 1] = LETTER
    capital = two[data[two + 1] < 0x9F] + 1
    named[capital] += 32
    odd = kind == OTHER
    quote = np.flatnonzero(data[:-1] == 39)
    odd[quote[kind[quote + 1] == LETTER]] = True
    angle = np.flatnonzero(data[:-1] == 60)
    odd[angle[data[angle + 1] == 124]] = True
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    cuts = said.copy()
    cuts[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    cuts[:1] = said[:1]
    if odd.any():
        at = np.unique(np.searchsorted(start, np.flatnonzero(odd), "right") - 1)
        n = end[at] - start[at]
        whole = np.repeat(start[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        named[whole], cuts[whole] = data[whole], False
        cuts[start[at]] = True
    stops = said[:-1] & (~said[1:] | cuts[1:])
    return np.flatnonzero(cuts), np.flatnonzero(stops) + 1, named, kind == LETTER


class Encoder:
    """Ids of texts by the tokenizer of a file.

    A tokenizer that joins across white space is given whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = max(self.tokenizer.get_vocab_size(with_added_tokens=True), END_ID + 1)
        self.mark = self._encode([f" {MARK} "])[0].ids
        # the tokens that end a word, where the vocabulary tells them
        end, self.last = getattr(self.tokenizer.model, "end_of_word_suffix", None), np.zeros(self.vocabulary, bool)
        if end:
            self.last[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(end)]] = True
        self.apart = len(self.mark) == 1 and self._parts_at_space()
        self.inner = self.apart and self._parts_inside()
        self.keys, self.start, self.n = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.pool, self.filled = np.zeros(1 << 16, np.uint32), 0

    def _encode(self, rows: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(rows, add_special_tokens=False)

    def _flat(self, rows: list[str]) -> np.ndarray:
        """The ids of all rows."""
        some = (self._encode(rows[i : i + ROWS]) for i in range(0, len(rows), ROWS))
        return np.concatenate([np.zeros(0, np.uint32), *(np.fromiter(chain.from_iterable(e.ids for e in got), np.uint32) for got in some)])

    def _same(self, whole: list[str], parts: list[list[str]]) -> bool:
        made = (e.ids for e in self._encode(list(chain.from_iterable(parts))))
        return all(e.ids == list(chain.from_iterable(next(made) for _ in p)) for e, p in zip(self._encode(whole), parts, strict=True))

    def _pieces(self) -> list[str]:
        """Each sign and letter of the kinds that are cut, in several neighbourhoods."""
        signs = [f"ab{c}{c}Cd{c}12{c}" for c in string.punctuation] + [f"{c}x{d}" for c in "(\"'-<." for d in string.punctuation]
        return signs + [f"a{c}b{c}!{c}" for c in string.ascii_letters + LATIN] + ["1a2", "A1", "don't", "a<|b", "'S", '("ÉTé")!']

    def _parts_at_space(self) -> bool:
        pieces = [*self._pieces(), "́e", "ΣΑΣ", "漢字", " x", MARK]
        return all(self._same([f"{p}{s}{q}" for p, q in zip(pieces, pieces[1:], strict=False)], [[p, q] for p, q in zip(pieces, pieces[1:], strict=False)]) for s in (" ", "  ", "\n", "\t", "\r\n", " \x0b\x0c"))

    def _parts_inside(self) -> bool:
        if any(not t.content.startswith("<|") for t in self.tokenizer.get_added_tokens_decoder().values()):
            return False
        pieces, parts = self._pieces(), []
        for p in pieces:
            start, end, named, _ = cut_units(np.frombuffer(p.encode() + b" ", np.uint8), True)
            parts.append([named[i:j].tobytes().decode() for i, j in zip(start, end, strict=True)])
        return self._same(pieces, parts)

    def _ids(self, new: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how many ids each has, the ids): runs of letters in rows without marks, as each is a word to the tokenizer."""
        plain, rest = [x for x, y in zip(new, letters, strict=True) if y], [x for x, y in zip(new, letters, strict=True) if not y]
        one = self._words(plain)
        if one is None:
            return self._marked(new)
        two = self._marked(rest)
        n = np.empty(len(new), np.int64)
        n[letters], n[~letters] = one[0], two[0]
        ids, of = np.empty(n.sum(), np.uint32), np.repeat(letters, n)
        ids[of], ids[~of] = one[1], two[1]
        return n, ids

    def _words(self, new: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """As ``_ids``, by the tokens that end a word; none where these aren't as many as the words."""
        ids = self._flat([" ".join(new[i : i + ROW]) for i in range(0, len(new), ROW)])
        n = np.diff(np.flatnonzero(self.last[ids]), prepend=-1)
        return (n, ids) if len(n) == len(new) and n.sum() == len(ids) else None

    def _marked(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_ids``, in rows with a mark between two units that is a token of its own; if any holds the mark, one by one."""
        if any(MARK in p for p in new):
            lists = [e.ids for e in self._encode(new)]
            n = np.fromiter(map(len, lists), np.int64, len(lists))
            return n, np.fromiter(chain.from_iterable(lists), np.uint32, n.sum())
        ids = self._flat([f" {MARK} ".join([*new[i : i + ROW], ""]) for i in range(0, len(new), ROW)])
        marks = np.flatnonzero(ids == self.mark[0])
        return np.diff(marks, prepend=-1) - 1, np.delete(ids, marks)

    def _add(self, ids: np.ndarray) -> int:
        """Puts ids at the end of the pool; where they begin."""
        start, end = self.filled, self.filled + len(ids)
        if end > len(self.pool):
            self.pool = np.concatenate((self.pool[:start], np.zeros(max(end, 2 * len(self.pool)) - start, np.uint32)))
        self.pool[start:end], self.filled = ids, end
        return start

    def _chunk(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start of each unit, number of its ids, the ids) of bytes that end with white space."""
        if self.filled > POOL:
            self.keys[:], self.filled = 0, 0
        start, end, named, letter = cut_units(data, self.inner)
        if not len(start):
            return start, np.zeros(0, np.int64), np.zeros(0, np.uint32)
        power, inverse = _powers() if len(data) <= CHUNK else powers(len(data))
        h = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTES[named] * power[: len(data)], out=h[1:])
        key = mix((h[end] - h[start]) * inverse[start] + (end - start).astype(np.uint64))
        del h
        at = (key & np.uint64(SLOTS - 1)).astype(np.int64)
        hit = self.keys[at] == key
        first, n = self.start[at].astype(np.int64), self.n[at].astype(np.int64)
        if not hit.all():
            lost = np.flatnonzero(~hit)
            new, where, back = np.unique(key[lost], return_index=True, return_inverse=True)
            i, j = start[lost[where]], end[lost[where]]
            raw, upto = named.tobytes(), np.cumsum(letter)
            letters = letter[i] & (upto[j - 1] - upto[i] == j - i - 1)
            made, ids = self._ids([raw[x:y].decode() for x, y in zip(i.tolist(), j.tolist(), strict=True)], letters)
            begin = self._add(ids)
            places = begin + np.cumsum(made) - made
            first[lost], n[lost] = places[back], made[back]
            slot = (new & np.uint64(SLOTS - 1)).astype(np.int64)
            self.keys[slot], self.start[slot], self.n[slot] = new, places, made
        upto = np.cumsum(n)
        return start, n, self.pool[np.repeat(first - upto + n, n) + np.arange(upto[-1])]

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts (UTF-8) one after the other, END_ID behind each; how many each text has)."""
        texts = [t or b"" for t in texts]
        if not self.apart:
            lists = [[*e.ids, END_ID] for e in self._encode([t.decode() for t in texts])]
            return np.fromiter(chain.from_iterable(lists), np.uint32), np.fromiter(map(len, lists), np.int64, len(lists))
        blob = b"\n".join([*texts, b""])
        data, bounds = np.frombuffer(blob, np.uint8), np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
        count, made, at = np.zeros(len(texts), np.int64), [], 0
        while at < len(data):
            to = _after_space(data, at, min(at + CHUNK, len(data)))
            start, n, ids = self._chunk(data[at:to])
            text = np.searchsorted(bounds, start + at, "right")
            count += np.bincount(text, n, len(texts)).astype(np.int64)
            made.append(ids)
            at = to
        out = np.full(int(count.sum()) + len(texts), END_ID, np.uint32)
        out[np.delete(np.arange(len(out)), np.cumsum(count + 1) - 1)] = np.concatenate([np.zeros(0, np.uint32), *made])
        return out, count + 1


BYTES = byte_table(3)


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    return powers(CHUNK)


def _after_space(data: np.ndarray, at: int, to: int) -> int:
    """The end of the last white space in at..to, or of the next one behind if there is none."""
    near = np.flatnonzero(CLASS[data[max(at, to - 4096) : to]] == SPACE)
    if len(near):
        return max(at, to - 4096) + int(near[-1]) + 1
    while True:
        far = np.flatnonzero(CLASS[data[to : to + 65536]] == SPACE)
        if len(far) or to >= len(data):
            return to + int(far[0]) + 1 if len(far) else len(data)
        to += 65536


@cache
def encoder(path: str) -> Encoder:
    """One for each Python process: later tasks of a worker go on with what it knows."""
    return Encoder(path)
