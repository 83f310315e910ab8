"""A full-text index in minute space over a sequence of small integers: suffix sort, wavelet ranks, sampled positions.

Symbol 0 is a separator: no pattern holds it, and suffixes are compared only as far as the next one.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Sorted suffixes; each separator counts as a symbol of its own, in order of place.

    Buckets of suffixes that agree so far are numbered by their first place in the order. A round sorts each bucket by
    the bucket numbers of the suffixes that start as many symbols later as the bucket agrees on; buckets of one are done.
    """
    n = len(symbols)
    gap = symbols == 0
    key = np.where(gap, np.cumsum(gap) - 1, symbols.astype(np.int64) + int(gap.sum()))
    order, slots = np.empty(n, np.int64), np.arange(n)
    rank = np.zeros(n + 1, np.int64)
    open_, k = slots, 0
    while len(open_):
        by = np.argsort(key)
        open_, key = open_[by], key[by]
        order[slots] = open_
        new = np.empty(len(key), bool)
        new[0] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(key)))
        rank[open_] = np.repeat(slots[first], size) + 1
        more = np.repeat(size > 1, size)
        open_, slots = open_[more], slots[more]
        k = max(1, 2 * k)
        # past the end nothing follows: 0
        key = rank[open_] << 32 | rank[np.minimum(open_ + k, n)]
    return order


class Bits:
    """A bit vector with ranks."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class Wavelet:
    """Ranks of any symbol in a sequence, one bit vector for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray):
        self.levels: list[tuple[int, int, Bits]] = []
        for bit in range(max(int(symbols.max(initial=0)).bit_length(), 1) - 1, -1, -1):
            ones = (symbols >> bit) & 1 == 1
            self.levels.append((bit, int(len(symbols) - ones.sum()), Bits(ones)))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often the symbol stands before place i."""
        start, end = np.zeros_like(i), i
        for bit, zeros, bits in self.levels:
            one = (symbol >> bit) & 1 == 1
            s, e = bits.ones(start), bits.ones(end)
            start, end = np.where(one, zeros + s, start - s), np.where(one, zeros + e, end - e)
        return end - start

    def get(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for bit, zeros, bits in self.levels:
            one = bits.get(i)
            e = bits.ones(i)
            out |= one.astype(np.int64) << bit
            i = np.where(one, zeros + e, i - e)
        return out


class FMIndex:
    def __init__(self, symbols: np.ndarray, every: int = 8):
        symbols = symbols.astype(np.int64)
        order = suffix_array(symbols)
        before = symbols[order - 1]
        before[order == 0] = 0
        self.n = len(symbols)
        self.bwt = Wavelet(before)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=1))])
        # sampled: every so many places, and where a walk backwards would meet a separator
        sampled = (order % every == 0) | (before == 0)
        self.sampled = Bits(sampled)
        self.places = order[sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of patterns, right-aligned rows of symbols over 0."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        top = len(self.less) - 1
        for step in range(patterns.shape[1]):
            go = np.flatnonzero((step < lengths) & (low < high))
            if not len(go):
                break
            c = patterns[go, patterns.shape[1] - 1 - step]
            known = c < top
            c = np.where(known, c, 0)
            low[go] = np.where(known, self.less[c] + self.bwt.rank(c, low[go]), 0)
            high[go] = np.where(known, self.less[c] + self.bwt.rank(c, high[go]), 0)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place of each suffix row: steps back to a sampled one."""
        out, at, steps = np.empty(len(rows), np.int64), rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            done = self.sampled.get(at[todo])
            hit = todo[done]
            out[hit] = self.places[self.sampled.ones(at[hit])] + steps[hit]
            todo = todo[~done]
            c = self.bwt.get(at[todo])
            at[todo] = self.less[c] + self.bwt.rank(c, at[todo])
            steps[todo] += 1
        return out
