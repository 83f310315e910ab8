"""What is known of distinct strings: lists of integers by the string's bytes, for vectorised look-ups."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import bytesops as B

ENTRIES = 3 << 18
#: Longer strings are made each time, so that the table's memory is bounded.
LONGEST = 128
_CHUNK = 1 << 17
_EMPTY = np.uint64((1 << 64) - 1)


class _Growing:
    """An array with room at its end."""

    def __init__(self, dtype: np.dtype):
        self.held, self.n = np.empty(1 << 16, dtype), 0

    def append(self, values: np.ndarray) -> None:
        need = self.n + len(values)
        if need > len(self.held):
            self.held = np.concatenate([self.held[: self.n], np.empty(max(need, 2 * len(self.held)) - self.n, self.held.dtype)])
        self.held[self.n : need] = values
        self.n = need


class KeyTable:
    """Whole numbers by 64-bit keys, in open addressing: a look-up of many keys is a few gathers."""

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.keys, self.values = np.full(1 << bits, _EMPTY), np.zeros(1 << bits, np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or the free one where it would be."""
        slot = (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.keys[slot]
        left = np.flatnonzero((there != keys) & (there != _EMPTY))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[left]]
            left = left[(there != keys[left]) & (there != _EMPTY)]
        return slot

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, whether found)."""
        slot = self._slot(keys)
        return self.values[slot], self.keys[slot] == keys

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """keys are distinct and new."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            full = self.keys != _EMPTY
            keys, values = np.concatenate([self.keys[full], keys]), np.concatenate([self.values[full], values])
            self.__init__(max(self.bits + 1, (4 * len(keys)).bit_length()))
        self.n += len(keys)
        left = np.arange(len(keys))
        while len(left):
            slot = self._slot(keys[left])
            # of several keys at one free slot the last one written has it
            self.keys[slot] = keys[left]
            won = self.keys[slot] == keys[left]
            self.values[slot[won]] = values[left[won]]
            left = left[~won]


class PartTable:
    """Results for each distinct string, found by a 64-bit hash and held against the string's bytes.

    make: from strings to (values of all, one after the other; how many each has).
    A table that is full starts anew; what is frequent comes back at once.
    """

    def __init__(self, make: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], dtype: np.dtype, entries: int = ENTRIES):
        self.make, self.dtype, self.entries = make, np.dtype(dtype), entries
        self._clear()

    def _clear(self) -> None:
        self.n = 0
        self.known = KeyTable(int(2 * (self.entries + _CHUNK)).bit_length())
        # place of each entry's bytes and values; the last is the end
        self.data, self.values = _Growing(np.uint8), _Growing(self.dtype)
        self.data_first, self.value_first = _Growing(np.int64), _Growing(np.int64)
        self.data_first.append(np.zeros(1, np.int64))
        self.value_first.append(np.zeros(1, np.int64))

    def _insert(self, keys: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> None:
        """keys are distinct and not in the table."""
        strings = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        values, count = self.make(strings)
        self.data.append(np.frombuffer(b"".join(strings), np.uint8))
        self.values.append(values)
        self.data_first.append(self.data_first.held[self.n] + np.cumsum(ends - starts))
        self.value_first.append(self.value_first.held[self.n] + np.cumsum(count))
        self.known.add(keys, np.arange(self.n, self.n + len(keys)))
        self.n += len(keys)

    def _some(self, data: np.ndarray, raw: bytes, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.n > self.entries:
            self._clear()
        size = ends - starts
        short = np.flatnonzero(size <= LONGEST)
        keys = keys[short]
        entry, found = self.known.find(keys)
        new = np.flatnonzero(~found)
        if len(new):
            found, at = np.unique(keys[new], return_index=True)
            at = short[new[at]]
            self._insert(found, raw, starts[at], ends[at])
            entry, _ = self.known.find(keys)
        begin, stop = self.data_first.held[entry], self.data_first.held[entry + 1]
        same = stop - begin == size[short]
        # equal hashes are no proof: the bytes decide
        cum = np.concatenate([[0], np.cumsum(np.where(same, size[short], 0))])
        inside = np.arange(cum[-1])
        gap = np.diff(cum)
        differ = self.data.held[inside + np.repeat(begin - cum[:-1], gap)] != data[inside + np.repeat(starts[short] - cum[:-1], gap)]
        if differ.any():
            same[np.searchsorted(cum, np.flatnonzero(differ), side="right") - 1] = False
        alone = np.ones(len(starts), bool)
        alone[short[same]] = False
        alone = np.flatnonzero(alone)
        if not len(alone):
            return B.ragged_take(self.values.held, self.value_first.held, entry)
        values, count = self.make([raw[a:b] for a, b in zip(starts[alone].tolist(), ends[alone].tolist(), strict=True)])
        first = np.concatenate([self.value_first.held[: self.n + 1], self.values.n + np.cumsum(count)])
        which = np.empty(len(starts), np.int64)
        which[short] = entry
        which[alone] = self.n + np.arange(len(alone))
        return B.ragged_take(np.concatenate([self.values.held[: self.values.n], values]), first, which)

    def lists(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, first) of the strings data[starts[i] : ends[i]], one list after the other."""
        raw = data.tobytes()
        keys = B.span_hash(B.prefix_hash(data), starts, ends)
        keys[keys == _EMPTY] = 0
        values, sizes = [np.empty(0, self.dtype)], [np.zeros(1, np.int64)]
        for k in range(0, len(starts), _CHUNK):
            s = slice(k, k + _CHUNK)
            found, first = self._some(data, raw, keys[s], starts[s], ends[s])
            values.append(found)
            sizes.append(np.diff(first))
        return np.concatenate(values), np.cumsum(np.concatenate(sizes))
