"""Merge rounds over ragged symbol arrays, shared by the two tokenizers.

Many words lie in one flat array. In every round the rank of each neighbouring
pair is looked up by binary search over the sorted pair keys, the lowest rank of
every word is taken by a segmented minimum, and all words merge at once.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

NONE = np.int64(1 << 40)


@dataclass(frozen=True)
class PairTable:
    """Pairs that may merge. ``keys`` = left * ``width`` + right, sorted; ``safe``
    tells that a merge never makes a pair of the same or a lower rank, so that all
    its occurrences in a word can merge in one round."""

    width: int
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    safe: np.ndarray

    @staticmethod
    def build(left, right, ranks, merged, width: int) -> "PairTable":
        left, right, ranks, merged = (np.asarray(x, np.int64) for x in (left, right, ranks, merged))
        key = left * width + right
        order = np.lexsort((ranks, key))
        first = np.r_[True, key[order][1:] != key[order][:-1]] if len(key) else np.zeros(0, bool)
        order = order[first]
        best = np.full(width, NONE)  # the lowest rank of a pair that holds the symbol
        np.minimum.at(best, left, ranks)
        np.minimum.at(best, right, ranks)
        return PairTable(width, key[order], ranks[order], merged[order], best[merged[order]] > ranks[order])

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the table and ranks; ``NONE`` where there is no such pair."""
        key = left.astype(np.int64) * self.width + right
        key[(left < 0) | (right < 0)] = -1
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return at, np.where(self.keys[at] == key, self.ranks[at], NONE)


#: From this many symbols on a word without safe merges goes through a heap.
LONG = 4096


def merge(table: PairTable, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge every word to the end. ``symbols``: all words' symbols, -1 for one
    that never merges; ``lengths``: symbols of each word. Returns the same two for
    the merged words, in the same order."""
    n = len(lengths)
    word = np.repeat(np.arange(n), lengths)
    symbols = symbols.astype(np.int64)
    if not len(table.keys):
        return symbols, np.asarray(lengths, np.int64)
    done_symbols, done_words = [], []
    at, rank = _ranks(table, symbols, word)
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        size = np.diff(np.r_[starts, len(word)])
        least = np.minimum.reduceat(rank, starts)
        live = np.repeat(least < NONE, size)
        if not live.all():
            done_symbols.append(symbols[~live])
            done_words.append(word[~live])
            symbols, word, at, rank = symbols[live], word[live], at[live], rank[live]
            continue
        hit = rank == np.repeat(least, size)
        index = np.arange(len(hit))
        begins = hit & ~np.r_[False, hit[:-1]]
        run = np.maximum.accumulate(np.where(begins, index, 0))
        take = hit & ((index - run) % 2 == 0)
        unsafe = hit & ~table.safe[at]
        if unsafe.any():
            slow = np.logical_or.reduceat(unsafe, starts)
            if (long := slow & (size >= LONG)).any():
                apart = np.repeat(long, size)
                for s, k in zip(starts[long], size[long]):
                    out = _by_heap(table, symbols[s : s + k])
                    done_symbols.append(out)
                    done_words.append(np.full(len(out), word[s]))
                symbols, word, at, rank = symbols[~apart], word[~apart], at[~apart], rank[~apart]
                continue
            first = np.minimum.reduceat(np.where(hit, index, len(hit)), starts)
            take &= ~np.repeat(slow, size) | (index == np.repeat(first, size))
        symbols[take] = table.merged[at[take]]
        gone = np.r_[False, take[:-1]]
        touched = take | np.r_[take[1:], False] | np.r_[take[2:], False, False]
        keep = ~gone
        symbols, word, at, rank, touched = symbols[keep], word[keep], at[keep], rank[keep], touched[keep]
        redo = np.flatnonzero(touched)
        at[redo], rank[redo] = _ranks(table, symbols, word, redo)
    if not done_words:
        return symbols, np.zeros(n, np.int64)
    symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
    order = np.argsort(word, kind="stable")
    return symbols[order], np.bincount(word, minlength=n).astype(np.int64)


def _ranks(table: PairTable, symbols: np.ndarray, word: np.ndarray, index: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol (or those at ``index``), its pair with the next one."""
    if index is None:
        index = np.arange(len(symbols))
    after = np.minimum(index + 1, len(symbols) - 1)
    right = np.where((after > index) & (word[after] == word[index]), symbols[after], -1)
    return table.look_up(symbols[index], right)


def _by_heap(table: PairTable, symbols: np.ndarray) -> np.ndarray:
    """One very long word, merged one pair at a time: lowest rank, then leftmost."""
    value = symbols.tolist()
    n = len(value)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    cache: dict[tuple[int, int], tuple[int, int]] = {}

    def pair(a: int, b: int) -> tuple[int, int]:
        if (a, b) not in cache:
            at, rank = table.look_up(np.array([a]), np.array([b]))
            cache[a, b] = int(rank[0]), int(table.merged[at[0]])
        return cache[a, b]

    heap = [(r, i, value[i], value[i + 1]) for i in range(n - 1) if (r := pair(value[i], value[i + 1])[0]) < NONE]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if value[i] != a or j < 0 or value[j] != b or value[i] is None:
            continue
        value[i], value[j] = pair(a, b)[1], None
        right[i] = right[j]
        if right[i] >= 0:
            left[right[i]] = i
        for x in (left[i], i):
            y = right[x] if x >= 0 else -1
            if x >= 0 and y >= 0 and (r := pair(value[x], value[y])[0]) < NONE:
                heapq.heappush(heap, (r, x, value[x], value[y]))
    return np.array([v for v in value if v is not None], np.int64)
