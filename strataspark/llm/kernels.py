"""Vectorised text kernels that run inside Arrow batches.

All of them view a run of documents as one byte buffer with document offsets, so that a batch costs a fixed
number of numpy passes whatever the number of documents. Buffers are cut at CHUNK bytes (a longer document is
a buffer of its own), which bounds the memory of a task by the longest document, not by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

CHUNK = 1 << 20
SPAN = 256  # bytes from which a span is hashed by itself
U64 = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words that spreads every bit."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, dtype=U64) + U64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def random_words(n: int, seed: int) -> np.ndarray:
    return splitmix(np.arange(n, dtype=U64) + U64(seed) * U64(1_000_003))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=4)
def _powers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i below n."""
    p = int(splitmix(np.array([_MULTIPLIER + seed], dtype=U64))[0]) & ~7 | 5  # 5 modulo 8: low powers stay far from 1
    q = pow(p, -1, 1 << 64)
    out = []
    for base in (p, q):
        a = np.full(n, base, dtype=U64)
        a[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(a, out=a)
        out.append(a)
    return out[0], out[1]


def powers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    size = CHUNK + 1
    while size < n:
        size *= 2
    a, b = _powers(size, seed)
    return a[:n], b[:n]


class Rolling:
    """64-bit hashes of any substrings of a buffer: prefix sums of byte codes times powers of an odd base. Modulo 2**64 there are
    texts of 512 characters and more that any such sum confuses, so spans of SPAN bytes or more get a hash that is not linear."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        self.data, self.seed = data, seed
        up, self.down = powers(len(data) + 1, seed)
        self.prefix = np.zeros(len(data) + 1, dtype=U64)
        with np.errstate(over="ignore"):
            np.cumsum(random_words(256, 77 + seed)[data] * up[:-1], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.prefix[end] - self.prefix[start]) * self.down[start]
            h = splitmix(h + (end - start).astype(U64))
        far = np.flatnonzero(end - start >= SPAN)
        if len(far):
            raw = memoryview(np.ascontiguousarray(self.data))
            h[far] = np.fromiter((xxhash.xxh3_64_intdigest(raw[s:e], self.seed) for s, e in zip(start[far].tolist(), end[far].tolist())), dtype=U64, count=len(far))
        return h

    def grams(self, n: int) -> np.ndarray:
        """The hash of the n bytes from every position that has n bytes after it."""
        if len(self.prefix) <= n:
            return np.empty(0, dtype=U64)
        with np.errstate(over="ignore"):
            return splitmix((self.prefix[n:] - self.prefix[:-n]) * self.down[: len(self.prefix) - n])


def chunks(text: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of at most ``limit`` bytes, or one longer row. Null: empty."""
    text = text.cast(pa.large_string()).fill_null("")
    if len(text) == 0:
        return
    off = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    raw = text.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, dtype=np.uint8)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def rows_of(off: np.ndarray) -> np.ndarray:
    """The document number of every byte."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the documents of a buffer: start, end, document number, words per document."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        ink = ~_SPACE[data]
        before = np.empty(len(data), dtype=bool)
        before[:1] = False
        before[1:] = ink[:-1]
        cut = off[(off < len(data))]
        before[cut] = False
        self.start = np.flatnonzero(ink & ~before)
        after = np.empty(len(data), dtype=bool)
        after[-1:] = False
        after[:-1] = ink[1:]
        after[cut[cut > 0] - 1] = False
        self.end = np.flatnonzero(ink & ~after) + 1
        self.first = np.searchsorted(self.start, off)  # the first word of each document, and the end
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(off) - 1), self.count)
        self.ink = ink


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def shingles(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``size`` words of each document and each document's first one; a shorter document
    with words gives one hash of its whole sequence, one without words none."""
    count = np.diff(first)
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    starts = np.zeros(len(count) + 1, dtype=np.int64)
    np.cumsum(n, out=starts[1:])
    doc = np.repeat(np.arange(len(count)), n)
    at = first[:-1][doc] + np.arange(starts[-1]) - starts[:-1][doc]
    out = np.zeros(len(at), dtype=U64)
    length = np.minimum(count, size)[doc]
    with np.errstate(over="ignore"):
        for k in range(size):
            some = length > k
            h = words[np.where(some, at + k, 0)] if len(words) else out
            out = np.where(some, splitmix(out * U64(31) + h), out)
    return splitmix(out + length.astype(U64)), starts


def repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per entry: does its key occur twice or more, and did it occur earlier."""
    if not len(key):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.zeros(len(k) + 1, dtype=bool)
    same[1:-1] = k[1:] == k[:-1]
    often, later = np.empty(len(k), bool), np.empty(len(k), bool)
    often[order] = same[:-1] | same[1:]
    later[order] = same[:-1]
    return often, later


def per_doc(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values (one a byte, or a word) over each document's range."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def per_doc_u64(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """As per_doc, modulo 2**64."""
    total = np.zeros(len(values) + 1, dtype=U64)
    with np.errstate(over="ignore"):
        np.cumsum(values, out=total[1:])
        return total[off[1:]] - total[off[:-1]]


def per_doc_range(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of values over ranges."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[end] - total[start]
