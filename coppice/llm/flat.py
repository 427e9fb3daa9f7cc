"""Hashes of words and word n-grams, computed on the flat bytes of Arrow strings.

No Python object is made for a word: a prefix sum of byte * base^position gives
the hash of any run of bytes, which a 64-bit mixer then spreads.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes that are hashed at once; arrays of 8 bytes per byte of text stand beside them.
_RUN = 1 << 20

SPACE, WORD, MARK = 0, 1, 2

#: Class of each byte: white space, or part of a word.
BY_SPACE = np.full(256, WORD, np.uint8)
BY_SPACE[[9, 10, 11, 12, 13, 32]] = SPACE
#: White space, letters and digits (and all of a non-ASCII letter), other marks.
BY_MARK = BY_SPACE.copy()
BY_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = MARK
#: ASCII capitals as small letters.
SMALL = np.arange(256, dtype=np.uint8)
SMALL[65:91] += 32

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            factor = np.full(n, base, np.uint64)
            factor[0] = 1
            _powers[i] = np.cumprod(factor, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings and the offset of each row; null is empty."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def row_runs(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) with about ``limit`` bytes, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


def words(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray = BY_SPACE, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word, in order. A word is a run of bytes of one class
    other than white space, within one row."""
    hashes, rows = [], []
    start, n = 0, len(data)
    edges = np.unique(offsets)
    while start < n:
        end = min(n, start + _RUN)
        while end < n and classes[data[end]] != SPACE:  # not inside a word
            step = np.flatnonzero(classes[data[end : end + 4096]] == SPACE)
            end = min(n, end + (int(step[0]) if len(step) else 4096))
        part = data[start:end]
        kind = classes[part]
        fresh = np.empty(len(part) + 1, bool)
        fresh[0] = fresh[-1] = True
        np.not_equal(kind[1:], kind[:-1], out=fresh[1:-1])
        inside = edges[np.searchsorted(edges, start) : np.searchsorted(edges, end)] - start
        fresh[inside] = True
        cuts = np.flatnonzero(fresh)
        first, last = cuts[:-1], cuts[1:]
        real = kind[first] != SPACE
        first, last = first[real], last[real]
        power, inverse = _power(len(part) + 1)
        value = (part if fold is None else fold[part]).astype(np.uint64) + np.uint64(1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(value * power[:-1], out=total[1:])
        h = (total[last] - total[first]) * inverse[first]
        hashes.append(mix(h + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        rows.append(np.searchsorted(offsets, first + start, "right") - 1)
        start = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(rows)


def ngrams(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every n-gram of words of the same row."""
    if len(hashes) < n:
        return hashes[:0], rows[:0]
    size = len(hashes) - n + 1
    h = np.full(size, n, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x100000001B3) + hashes[i : i + size]
        h ^= h >> np.uint64(29)
    same = rows[:size] == rows[n - 1 :]
    return mix(h[same]), rows[:size][same]


def shingles(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each row: row (sorted), hash, and how often it
    stands there. A row of fewer than n words, but one at least, has its whole
    sequence of words as its only shingle."""
    h, r = ngrams(hashes, rows, n)
    count = np.bincount(rows) if len(rows) else np.zeros(0, np.int64)
    for k in range(1, n):
        if (short := np.flatnonzero(count == k)).size:
            apart = np.isin(rows, short)
            h2, r2 = ngrams(hashes[apart], rows[apart], k)
            h, r = np.r_[h, h2], np.r_[r, r2]
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])]) if len(h) else np.zeros(0, np.int64)
    return r[first], h[first], np.diff(np.r_[first, len(h)])
