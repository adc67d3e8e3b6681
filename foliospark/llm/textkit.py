"""Vectorised words, hashes and batches over Arrow text columns, shared by the operators.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r; all of these are ASCII, so
words of UTF-8 bytes are words of code points. Word identity is a 64-bit fingerprint
(polynomial hash, then a mixing step): among n distinct words the chance that any two
collide is about n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes between terms: every ASCII byte that is no letter and no digit.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C55)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes that words() works on at once.
CHUNK = 1 << 20
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


class Texts(NamedTuple):
    """UTF-8 bytes of some texts laid end to end, and where each begins (one more offset at the end)."""

    data: np.ndarray
    offsets: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


class Words(NamedTuple):
    """Word bounds in bytes, their hashes, and the index of each text's first word (one more at the end)."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def as_texts(column: pa.Array | pa.ChunkedArray) -> Texts:
    """The bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(whole[at[0] : at[-1]], at - at[0])


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Cuts batches by rows into slices of at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        texts = as_texts(batch.column(text))
        begin, n = 0, batch.num_rows
        while begin < n:
            end = int(np.searchsorted(texts.offsets, texts.offsets[begin] + limit, "right")) - 1
            end = min(max(end, begin + 1), n)
            at = texts.offsets[begin : end + 1]
            yield batch.slice(begin, end - begin), Texts(texts.data[at[0] : at[-1]], at - at[0])
            begin = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing step on 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        size = (n >> 18) + 1 << 18
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0], _powers[1]


def stems(texts: Texts, w: Words, size: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first ``size`` bytes of the words longer than that, and the index of each
    text's first."""
    data = _LOWER[texts.data] if lower else texts.data
    long = w.ends - w.starts > size
    begin = w.starts[long]
    total = np.zeros(len(begin), np.uint64)
    up, _ = _power(size)
    for k in range(size):
        total += (data[begin + k].astype(np.uint64) + np.uint64(1)) * up[k]
    first = np.zeros(len(long) + 1, np.int64)
    np.cumsum(long, out=first[1:])
    return mix(total ^ np.uint64(0x5DEECE66D)), first[w.first]


def words(texts: Texts, lower: bool = True, breaks: np.ndarray = _BLANK) -> Words:
    """Splits every text into words at the bytes in ``breaks``; ``lower`` folds A-Z before hashing.
    Works through CHUNK bytes at a time, cut between words, so beside the result (24 bytes a word) a
    long text needs no more memory than a short one."""
    data, offsets = texts
    parts, at = [], 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        while end < len(data) and not breaks[data[end]]:  # a word goes on here: to its end
            ahead = np.flatnonzero(breaks[data[end : end + CHUNK]])
            end = end + int(ahead[0]) if len(ahead) else min(end + CHUNK, len(data))
        inside = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end, "right")] - at
        starts, ends, hashes = _words(data[at:end], inside, lower, breaks)
        parts.append((starts + at, ends + at, hashes))
        at = end
    none = np.zeros(0, np.int64)
    starts, ends, hashes = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (none, none, none.view(np.uint64))
    return Words(starts, ends, hashes, np.searchsorted(starts, offsets))


def _words(data: np.ndarray, offsets: np.ndarray, lower: bool, breaks: np.ndarray):
    n = len(data)
    blank = breaks[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, blank[:-1]
    starts = np.flatnonzero(~blank & (before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, blank[1:]
    ends = np.flatnonzero(~blank & (after | edge[1:])) + 1
    up, down = _power(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(((_LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    return starts, ends, mix((total[ends] - total[starts]) * down[starts])


def word_hash(word: str, lower: bool = True) -> int:
    """The hash that words() gives this word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(words(Texts(data, np.array([0, len(data)])), lower).hashes[0])


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within a text, and the index of each text's first
    run (one more at the end). A text of fewer words, but one at least, has one run: all of it."""
    counts = w.counts
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.zeros(len(runs) + 1, np.int64)
    np.cumsum(runs, out=first[1:])
    begin = np.arange(first[-1]) - np.repeat(first[:-1], runs) + np.repeat(w.first[:-1], runs)
    have = np.repeat(np.minimum(counts, size), runs)
    out = np.full(len(begin), 0x1234567, np.uint64) + have.astype(np.uint64)
    padded = np.concatenate([w.hashes, np.zeros(size, np.uint64)])
    weight = 0x9E3779B97F4A7C15
    for k in range(size):
        part = mix(padded[begin + k] + np.uint64(weight * (k + 1) % (1 << 64)))
        out += np.where(have > k, part, np.uint64(0))
    return mix(out), first


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of each text's run of values; texts without any have 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def unique_in_texts(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values within each text, and the index of each text's first."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[keep], o[keep]
    return h, np.searchsorted(o, np.arange(len(first)))
