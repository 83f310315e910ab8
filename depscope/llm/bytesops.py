"""Vectorised helpers over the UTF-8 bytes of Arrow text columns.

All functions work on one piece of a record batch (a few MB), never on more,
so their memory is bounded by the piece and by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 19
#: Hashes are polynomials over the field of this many numbers, at two points fixed by a random draw: texts of n bytes that
#: differ have equal values at n of the field's numbers at most, whatever their structure.
_PRIME = (1 << 31) - 1
_rng = np.random.default_rng(20240229)
_POINTS = [int(x) for x in _rng.integers(1 << 24, _PRIME - 1, 2)]
_BYTE_VALUES = _rng.integers(1, _PRIME, (2, 256), dtype=np.uint64)
#: Powers of the two points and of their inverses.
_powers = [np.ones(1, np.uint64)] * 4

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_SPACE = ~SPACE
#: Digits, a-z (after lower-casing) and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def bind_columns(batch: pa.RecordBatch, at: int, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch whose texts in column `at` take at most `limit` bytes (or that have one row)."""
    lengths = pc.binary_length(batch.column(at)).fill_null(0).to_numpy(zero_copy_only=False)
    if lengths.sum() <= limit:
        if batch.num_rows:
            yield batch
        return
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    yield batch.slice(start)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty. offsets[i]:offsets[i + 1] is row i."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or off[-1] == off[0]:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def _folded(x: np.ndarray) -> np.ndarray:
    """The same number of the field, below 2^31 + 2^33 for any of 64 bits, and below 2^31 + 4 if folded twice."""
    return (x & np.uint64(_PRIME)) + (x >> np.uint64(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    x = _folded(_folded(x))
    return np.where(x >= _PRIME, x - np.uint64(_PRIME), x)


def _powers_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, PIECE_BYTES + (PIECE_BYTES >> 2))
        for k, base in enumerate([*_POINTS, *(pow(x, -1, _PRIME) for x in _POINTS)]):
            p = _powers[k]
            while len(p) < n:
                p = np.concatenate([p, _reduced(p * np.uint64(pow(base, len(p), _PRIME)))])
            _powers[k] = p
    return _powers


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Two rows of sums from which span_hash() reads the hash of any span of `data`."""
    out = np.zeros((2, len(data) + 1), np.uint64)
    power = _powers_to(len(data) + 1)
    for k in range(2):
        values = _BYTE_VALUES[k][data]
        values *= power[k][: len(data)]
        np.cumsum(_folded(values), out=out[k, 1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _joined(parts: list[np.ndarray], lengths: np.ndarray | int) -> np.ndarray:
    h = parts[0] | parts[1] << np.uint64(31)
    h += np.asarray(lengths).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(h)


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span, of 62 bits of content, the same wherever they stand; lengths enter it."""
    power = _powers_to(sums.shape[1])
    return _joined([_reduced(_folded(_folded(sums[k][ends] - sums[k][starts])) * power[2 + k][starts]) for k in range(2)], ends - starts)


def window_hash(sums: np.ndarray, width: int) -> np.ndarray:
    """span_hash() of every span of so many bytes."""
    power, n = _powers_to(sums.shape[1]), max(sums.shape[1] - width, 0)
    return _joined([_reduced(_folded(_folded(sums[k][width:] - sums[k][:n])) * power[2 + k][:n]) for k in range(2)], width)


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): maximal runs of table bytes within each text; text i has words first[i]:first[i + 1]."""
    if not len(data):
        z = np.empty(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = table[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = inside[0], False
    np.logical_and(inside[1:], ~inside[:-1], out=edge[1:-1])
    cut = offsets[1:-1][offsets[1:-1] < len(data)]
    edge[cut] = inside[cut]
    starts = np.flatnonzero(edge)
    edge[0], edge[-1] = False, inside[-1]
    np.logical_and(inside[:-1], ~inside[1:], out=edge[1:-1])
    cut = offsets[1:-1][offsets[1:-1] > 0]
    edge[cut] = inside[cut - 1]
    return starts, np.flatnonzero(edge), np.searchsorted(starts, offsets)


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of the lines between \\n; an empty text has one empty line."""
    breaks = np.flatnonzero(data == 10)
    at = np.searchsorted(breaks, offsets)
    n = len(offsets) - 1
    first = at + np.arange(n + 1)
    starts = np.empty(len(breaks) + n, np.int64)
    ends = np.empty_like(starts)
    is_first = np.zeros(len(starts), bool)
    is_first[first[:-1]] = True
    starts[is_first] = offsets[:-1]
    starts[~is_first] = breaks + 1
    is_last = np.zeros(len(starts), bool)
    is_last[first[1:] - 1] = True
    ends[is_last] = offsets[1:]
    ends[~is_last] = breaks
    return starts, ends, first


def row_of(first: np.ndarray) -> np.ndarray:
    """The text of each word or line, from its `first`."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of all runs of `size` words of each text; a text with fewer words, but not none, has its whole sequence."""
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    out_first = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(out_first[-1]) - np.repeat(out_first[:-1], count) + np.repeat(first[:-1], count)
    length = np.repeat(np.minimum(n, size), count)
    h = length.astype(np.uint64)
    short = length < size
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    for k in range(size):
        part = padded[at + k]
        if short.any():
            part = np.where(k < length, part, np.uint64(0))
        h = h * np.uint64(0xC2B2AE3D27D4EB4F) + part
    return mix(h), out_first


def ragged_take(flat: np.ndarray, first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, first) of the lists `which`, one after the other; list i is flat[first[i] : first[i + 1]]."""
    size = (first[1:] - first[:-1])[which]
    out_first = np.concatenate([[0], np.cumsum(size)])
    return flat[np.arange(out_first[-1]) + np.repeat(first[which] - out_first[:-1], size)], out_first
