"""Vectorised words and shingles of a batch of texts.

Words are runs outside the six ASCII white-space characters. Each gets a 64-bit fingerprint: a
polynomial over its bytes through a table of random numbers, mixed at the end. Two different words
share one with odds of about 2**-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

M = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D


def tidy() -> None:
    """Gives freed memory back to the system. Python workers are reused by later stages and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over a task's batches that tidies up when the task ends."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        tidy()

    return whole


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers over all bits, one to one."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, modulo 2**64."""
    out = []
    for b in (_BASE, pow(_BASE, -1, 2**64)):
        p = np.full(n + 1, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p, out=p))
    return out[0], out[1]


def byte_table(seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64)


def prefix_hash(data: np.ndarray, power: np.ndarray, seed: int = 1) -> np.ndarray:
    """h with h[j] - h[i] = sum of table[byte] * base**position over positions i..j-1."""
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_table(seed)[data] * power[: len(data)], out=h[1:])
    return h


#: Characters fingerprinted at once: working arrays take some 60 bytes for each byte of text.
PART = 600_000


def parts(texts) -> list[tuple[int, int]]:
    """(from, to) of runs of texts with about ``PART`` characters; a longer text is a run of its own."""
    ends = np.cumsum([len(t) if t else 0 for t in texts])
    out, at = [], 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART, "right")))
        out.append((at, to))
        at = to
    return out


class Batch:
    """Words of several texts: ``hashes`` of all words in order, and ``offsets`` of each text's words."""

    def __init__(self, texts, lower: bool) -> None:
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        if lower:
            raw = [t.lower() for t in raw]  # bytes.lower() changes A-Z alone
        self.raw = raw
        blob = b" ".join(raw) + b" "
        data = np.frombuffer(blob, np.uint8)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.diff(np.concatenate(([True], space)).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        power, inverse = powers(len(data))
        h = prefix_hash(data, power)
        self.hashes = mix((h[self.end] - h[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        bounds = np.concatenate(([0], np.cumsum(lens + 1)))
        self.offsets = np.searchsorted(self.start, bounds)
        self.bounds, self.data = bounds, data

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of each run of ``size`` words; of the whole sequence if it is shorter; none without words."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(size, n)
    out = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        out = mix(out * M + hashes[k : n - size + 1 + k] + np.uint64(k + 1))
    return out
