"""Vectorised words, shingles and prefixes over Arrow text columns.

A word is a maximal run of digits, ASCII letters (lower-cased) and code points from U+0080 on.
UTF-8 bytes of such code points are all 0x80 or more, so the same runs are found on raw bytes,
which numpy scans without building a Python object per word.  Every hash is a fixed function of
the bytes: equal words have equal hashes on every executor and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
PIECE_BYTES = 2 << 20

_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and shift-xor rounds)."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, U64)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_STEP = U64(0xD6E8FEB86659FD93)
_powers = np.ones(1, U64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 1024), _STEP, U64)
        p[0] = 1
        with np.errstate(over="ignore"):
            _powers = np.multiply.accumulate(p)
    return _powers[:n]


@dataclass
class Words:
    """The words of some rows: ``ptr[i]:ptr[i+1]`` are those of the i-th row."""

    first: int
    data: np.ndarray  # lower-cased bytes
    offsets: np.ndarray  # row i is data[offsets[i]:offsets[i+1]]
    start: np.ndarray
    length: np.ndarray
    hash: np.ndarray
    ptr: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.ptr) - 1

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.ptr))

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.start[i] : self.start[i] + self.length[i]].tobytes()


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; nulls are empty."""
    col = pc.fill_null(col, "")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offsets = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and col.buffers()[2].size else np.zeros(0, np.uint8)
    return data, offsets


def split(data: np.ndarray, offsets: np.ndarray, first: int = 0) -> Words:
    base = offsets[0]
    raw = data[base : offsets[-1]]
    offsets = offsets - base
    low = _LOWER[raw]
    inside = _IS_WORD[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(begin)
    length = np.flatnonzero(finish) + 1 - start
    ptr = np.searchsorted(start, offsets)
    hashes = np.zeros(len(start), U64)
    ends = np.cumsum(length)
    a = 0
    while a < len(start):  # words of some bytes at a time: eight bytes and more are held for each of these
        done = ends[a] - length[a]
        b = max(a + 1, int(np.searchsorted(ends, done + 2 * PIECE_BYTES, "right")))
        n = length[a:b]
        cut = ends[a:b] - n - done
        pos = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(cut, n)
        with np.errstate(over="ignore"):
            vals = _BYTE[low[np.repeat(start[a:b], n) + pos]] * powers(int(n.max()))[pos]
            hashes[a:b] = mix(np.add.reduceat(vals, cut) + n.astype(U64))
        a = b
    return Words(first, low, offsets, start, length, hashes, ptr)


def cuts(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, one row at least: long batches are worked on
    in pieces, so that memory follows the longest row and not the batch."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def pieces(col: pa.Array, limit: int = PIECE_BYTES) -> Iterator[Words]:
    data, offsets = buffers(col)
    for lo, hi in cuts(offsets, limit):
        yield split(data, offsets[lo : hi + 1], lo)


def windows(w: Words, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on; meaningful where the row has that many left."""
    out = np.zeros(len(w.hash), U64)
    with np.errstate(over="ignore"):
        for j in range(min(size, len(w.hash))):
            out[: len(out) - j] += w.hash[j:] * powers(size + 1)[j + 1]
    return mix(out + U64(size))


def left(w: Words) -> np.ndarray:
    """Words from each word to the end of its row."""
    return np.repeat(w.ptr[1:], np.diff(w.ptr)) - np.arange(len(w.hash))


@dataclass
class Bags:
    """Distinct elements of each row with their counts, by row, then by hash."""

    row: np.ndarray
    hash: np.ndarray
    count: np.ndarray
    ptr: np.ndarray


def bags(row: np.ndarray, hashes: np.ndarray, rows: int) -> Bags:
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(row)))
    return Bags(row[at], hashes[at], count, np.searchsorted(row[at], np.arange(rows + 1)))


def shingles(w: Words, size: int = 5) -> Bags:
    """Multisets of ``size``-word shingles; a row of fewer words, but not none, has one of all."""
    n = np.diff(w.ptr)
    ok = left(w) >= size
    hashes, row = windows(w, size)[ok], w.row_of()[ok]
    for k in range(1, size):
        short = np.flatnonzero(n == k)
        if len(short):
            hashes = np.concatenate([hashes, windows(w, k)[w.ptr[short]]])
            row = np.concatenate([row, short])
    return bags(row, hashes, w.rows)


def prefixes(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and hashes of the first ``size`` bytes of words longer than that."""
    at = np.flatnonzero(w.length > size)
    out = np.zeros(len(at), U64)
    p = powers(size + 1)
    with np.errstate(over="ignore"):
        for j in range(size):
            out += _BYTE[w.data[w.start[at] + j]] * p[j]
    return at, mix(out ^ U64(0xA5A5A5A5A5A5A5A5) + U64(size))


def word_hash(word: str) -> int:
    """The hash of one word, as :func:`split` gives it."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(split(raw, np.array([0, len(raw)])).hash[0])


class Bits:
    """A bit table that holds hashes by their low bits: it lets by all members and few others."""

    def __init__(self, hashes: np.ndarray, bits: int = 20):
        self.mask = U64((1 << bits) - 1)
        self.table = np.zeros(1 << bits, bool)
        self.table[(np.asarray(hashes, U64) & self.mask).astype(np.int64)] = True

    def maybe(self, hashes: np.ndarray) -> np.ndarray:
        """Positions in ``hashes`` that may be members."""
        return np.flatnonzero(self.table[(hashes & self.mask).astype(np.int64)])


class HashSet:
    """Membership of 64-bit hashes: a bit table first, then a binary search of what it lets by."""

    def __init__(self, hashes: np.ndarray, bits: int = 20):
        self.sorted = np.unique(np.asarray(hashes, U64))
        self.bits = Bits(self.sorted, bits)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``hashes`` that are members, and their places in ``sorted``."""
        if not len(self.sorted) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = self.bits.maybe(hashes)
        place = np.minimum(np.searchsorted(self.sorted, hashes[at]), len(self.sorted) - 1)
        good = self.sorted[place] == hashes[at]
        return at[good], place[good]
