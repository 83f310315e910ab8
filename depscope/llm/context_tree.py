"""LM scoring by context-tree weighting over bytes.

A text (A-Z lower-cased) is its UTF-8 bytes and one END byte, each byte eight binary decisions. A decision is
predicted from the last 0 to DEPTH bytes: every context and every node of the byte's binary decomposition has a
Krichevsky-Trofimov estimate from its counts, and a context's weighted probability is half its own estimate and
half the product of its children's, so that the prediction mixes all depths with weights that the training data sets.

Counts come from all training texts: runs of DEPTH + 1 bytes are counted in each task, then summed by a shuffle. Every
context of the training texts is a node of the tree, at any size of the corpus. Weights are made level by level, and
only for decisions that training texts met, as all others are even: the levels of three bytes or more by tasks that
hold the runs of whole three-byte contexts, the levels above, which two bytes bound, on the driver. Each distinct run
of any text then gets its one prediction. Runs that make up one in RUN_SHARE places or more, so RUN_SHARE at most, are
broadcast with theirs; all other runs are joined with theirs by a shuffle.

The base is an add-one unigram model over words (`[^\\x20\\x09-\\x0D]+`, lower-cased) and an end token per text. Words
that make up one in WORD_SHARE tokens or more, so WORD_SHARE at most, are broadcast with their counts; all other
words are joined with theirs by shuffles.

Defined cases: a null text is empty (its end token alone); a null id hashes as the empty string; rows are scored one
by one; without training texts every count is 0 and the model gives every byte 1 / 256;
repeated rows count, and are scored, each for itself; a text of any length is one row, scored by its distinct words and runs; an
empty table gives an empty result; extra columns, of any name, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B
from .rows import picked
from .scratch import written

DEPTH = 5
END = 0xFF
RUN_SHARE = 1 << 22
WORD_SHARE = 1 << 18
_CHUNK = 1 << 22
_HELD = 1 << 22
_ROWS = 1024
_RUNS = 1 << 17
#: Bytes of a context whose runs one task holds together.
_TOP = 3
#: No run: runs have 48 bits.
_EMPTY = np.uint64((1 << 64) - 1)
#: The word key of the end token; words have hashes, one in 2**64 of them this one.
END_KEY = 0x454E445F544F4B45


def _padded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, places, first): each text after DEPTH END bytes and before one; the places to predict, and each text's first."""
    data, off = B.text_bytes(texts)
    n = np.diff(off)
    size = n + DEPTH + 1
    begin = np.cumsum(size) - size
    out = np.full(int(size.sum()), END, np.uint8)
    first = np.concatenate([[0], np.cumsum(n + 1)])
    row = np.repeat(np.arange(len(n)), n + 1)
    places = np.arange(first[-1]) - first[:-1][row] + begin[row] + DEPTH
    out[np.delete(places, first[1:] - 1)] = B.LOWER[data]
    return out, places, first


def _word_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, off = B.text_bytes(texts)
    data = B.LOWER[data]
    starts, ends, first = B.word_spans(data, off)
    return B.span_hash(B.prefix_hash(data), starts, ends), first


class _Sums:
    """Counts by key, held sorted."""

    def __init__(self):
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.new: list[np.ndarray] = []
        self.n = 0

    def add(self, keys: np.ndarray) -> None:
        self.new.append(keys)
        self.n += len(keys)
        if self.n >= _CHUNK:
            self.settle()

    def settle(self) -> None:
        if not self.n:
            return
        x = np.concatenate(self.new)
        self.new, self.n = [], 0
        x.sort()
        at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        keys, counts = np.concatenate([self.keys, x[at]]), np.concatenate([self.counts, np.diff(np.append(at, len(x)))])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.keys, self.counts = keys[at], np.add.reduceat(counts, at)

    def rows(self, kind: int) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(self.keys), 1 << 16):
            keys, counts = self.keys[k : k + (1 << 16)], self.counts[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(counts)], names=["kind", "key", "n"])
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)


def _runs(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The DEPTH + 1 bytes that end at each place, the last one lowest."""
    out = np.zeros(len(places), np.uint64)
    for j in range(DEPTH, -1, -1):
        out = out << np.uint64(8) | data[places - j]
    return out


def corpus_counts(texts: DataFrame) -> DataFrame:
    """(kind, key, n): runs of DEPTH + 1 bytes (kind 0) and words (kind 1) of the training texts, runs of the held-out ones (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [_Sums(), _Sums(), _Sums()]
        for batch in batches:
            for piece in B.bind_columns(batch, 1):
                held = piece.column(0).to_numpy(zero_copy_only=False)
                for kind, mask in ((0, ~held), (2, held)):
                    part = piece.column(1).filter(pa.array(mask))
                    data, places, _ = _padded(part)
                    sums[kind].add(_runs(data, places))
                    if kind == 0:
                        words, _ = _word_keys(part)
                        sums[1].add(np.concatenate([words, np.full(len(part), END_KEY, np.uint64)]))
            for kind, s in enumerate(sums):
                if len(s.keys) > _HELD:
                    yield from s.rows(kind)
        for kind, s in enumerate(sums):
            s.settle()
            yield from s.rows(kind)

    return texts.select("held_out", "text").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for positive x: Stirling's series from 8 on, by recurrence below."""
    small = x < 8
    shift = np.ones_like(x)
    y = np.where(small, x + 8, x)
    for k in range(8):
        shift = np.where(small, shift * (x + k), shift)
    inv = 1 / y
    sq = inv * inv
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + inv * (1 / 12 - sq * (1 / 360 - sq * (1 / 1260 - sq / 1680))) - np.log(shift)


def _block(pair: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of pair[..., 0] zeros and pair[..., 1] ones."""
    a, b = pair[..., 0], pair[..., 1]
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1) - np.log(np.pi)


def _one(pair: np.ndarray) -> np.ndarray:
    """Its probability that the next is a one."""
    return (pair[..., 1] + 0.5) / (pair[..., 0] + pair[..., 1] + 1)


def _nodes(counts: np.ndarray) -> np.ndarray:
    """[contexts, 255, 2]: how often each node of the byte's decomposition went to 0 and to 1."""
    heap = np.zeros((len(counts), 512))
    heap[:, 256:] = counts
    for q in range(255, 0, -1):
        heap[:, q] = heap[:, 2 * q] + heap[:, 2 * q + 1]
    return heap[:, 2:].reshape(len(counts), 255, 2)


class ContextTree:
    """The model in memory, for a small corpus: log10 probability of each byte at every node, and the node that each older byte leads to."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        """levels[d]: sorted contexts of d bytes (the last one lowest) and their counts [contexts, 256]; level 0 has the empty one."""
        parent = [None] + [np.searchsorted(levels[d - 1][0], levels[d][0] & np.uint64((1 << 8 * (d - 1)) - 1)) for d in range(1, len(levels))]
        rest, stop, own_one = [None] * len(levels), [None] * len(levels), [None] * len(levels)
        below = below_counts = None
        for d in range(len(levels) - 1, -1, -1):
            counts = levels[d][1]
            left = counts.copy()
            product = np.zeros((len(counts), 255))
            if below is not None:
                np.add.at(product, parent[d + 1], below)
                np.subtract.at(left, parent[d + 1], below_counts)
            stop[d], own_one[d] = np.ones((len(counts), 255), np.float32), np.empty((len(counts), 255), np.float32)
            rest[d] = np.empty((len(counts), 255), np.float32) if d < DEPTH else None
            for k in range(0, len(counts), _ROWS):
                s = slice(k, k + _ROWS)
                pair = _nodes(counts[s])
                own = _block(pair)
                own_one[d][s] = _one(pair)
                if d == DEPTH:
                    product[s] = own
                    continue
                pair = _nodes(left[s])
                weighted = np.logaddexp(own, product[s] + _block(pair)) - np.log(2)
                stop[d][s], rest[d][s] = np.exp(own - np.log(2) - weighted), _one(pair)
                product[s] = weighted
            below, below_counts = product, counts
        base = np.cumsum([0, *(len(c) for c, _ in levels)])
        self.child = np.full((base[-1], 256), -1, np.int32)
        self.log10 = np.empty((base[-1], 256), np.float32)
        mixed, free = np.zeros((len(levels[0][0]), 255), np.float32), np.ones((len(levels[0][0]), 255), np.float32)
        for d, (contexts, _) in enumerate(levels):
            if d:
                mixed, free = mixed[parent[d]], free[parent[d]]
                self.child[base[d - 1] + parent[d], (contexts >> np.uint64(8 * (d - 1))).astype(np.int64)] = base[d] + np.arange(len(contexts))
            mixed = mixed + free * stop[d] * own_one[d]
            free = free * (1 - stop[d])
            one = mixed if rest[d] is None else mixed + free * rest[d]
            for k in range(0, len(contexts), _ROWS):
                p = np.clip(one[k : k + _ROWS].astype(np.float64), 1e-9, 1 - 1e-9)
                heap = np.zeros((len(p), 512))
                for q in range(1, 256):
                    heap[:, 2 * q] = heap[:, q] + np.log10(1 - p[:, q - 1])
                    heap[:, 2 * q + 1] = heap[:, q] + np.log10(p[:, q - 1])
                self.log10[base[d] + k : base[d] + k + len(p)] = heap[:, 256:]

    def score(self, texts: pa.Array) -> np.ndarray:
        """log10 probability of each text with its END."""
        data, places, first = _padded(texts)
        node = np.zeros(len(places), np.int32)
        going = np.arange(len(places))
        at, here = node, places
        for j in range(1, DEPTH + 1):
            at = self.child[at, data[here - j]]
            ok = at >= 0
            going, at, here = going[ok], at[ok], here[ok]
            node[going] = at
        return np.add.reduceat(self.log10[node, data[places]].astype(np.float64), first[:-1]) if len(first) > 1 else np.empty(0)


def _summed(codes: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(distinct codes in order, the place of each code among them, sums of the values)."""
    found, at = np.unique(codes, return_inverse=True)
    return found, at, [np.bincount(at, v, minlength=len(found)) for v in values]


class _Level:
    """Decisions met in contexts of one length: codes context << 8 | heap place, with their estimate and weight."""

    def __init__(self, codes: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None):
        """below: sum of the children's weighted logs; None where contexts have no children."""
        pair = np.stack([n0, n1], axis=-1)
        self.codes, self.n0, self.n1, self.one = codes, n0, n1, _one(pair)
        own = _block(pair)
        self.weighted = own if below is None else np.logaddexp(own, below) - np.log(2)
        self.stop = np.ones(len(codes)) if below is None else np.exp(own - np.log(2) - self.weighted)
        self.up = self.mixed = self.free = None

    def shorter(self, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(codes, n0, n1, weighted logs) summed over the contexts that agree on their last d bytes."""
        codes, self.up, sums = _summed(self.codes & np.uint64((1 << 8 * (d + 1)) - 1), self.n0, self.n1, self.weighted)
        return codes, *sums

    def mix(self, mixed: np.ndarray, free: np.ndarray) -> None:
        """mixed, free: of each decision's shorter context, the probability of a one so far and the weight still to give."""
        self.mixed, self.free = mixed + free * self.stop * self.one, free * (1 - self.stop)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.codes, codes), max(len(self.codes) - 1, 0))
        return at, self.codes[at] == codes if len(self.codes) else np.zeros(len(codes), bool)


def _deep_levels(keys: np.ndarray, n: np.ndarray) -> list[_Level]:
    """Levels DEPTH to _TOP of the runs' contexts; the runs hold each context of _TOP bytes whole."""
    met = n > 0
    keys, n = keys[met], n[met].astype(np.float64)
    byte, context = keys & np.uint64(255), keys >> np.uint64(8) << np.uint64(8)
    codes = np.concatenate([context | (byte | np.uint64(256)) >> np.uint64(8 - k) for k in range(8)])
    bit = np.concatenate([byte >> np.uint64(7 - k) & np.uint64(1) for k in range(8)]).astype(np.float64)
    n = np.tile(n, 8)
    codes, _, (n0, n1) = _summed(codes, n * (1 - bit), n * bit)
    levels = [_Level(codes, n0, n1, None)]
    for d in range(DEPTH - 1, _TOP - 1, -1):
        levels.append(_Level(*levels[-1].shorter(d)))
    return levels


def _whole_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, n) of many runs at a time, cut where the last _TOP bytes of the context change; batches are in their order."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= _RUNS:
            top = np.concatenate([b.column(0).to_numpy() for b in held])
            cut = int(np.flatnonzero(top != top[-1])[-1]) + 1 if top[0] != top[-1] else 0
            if cut:
                table = pa.Table.from_batches(held)
                yield table.column(1).to_numpy()[:cut].astype(np.uint64), table.column(2).to_numpy()[:cut]
                held, rows = table.slice(cut).to_batches(), rows - cut
    if rows:
        table = pa.Table.from_batches(held)
        yield table.column(1).to_numpy().astype(np.uint64), table.column(2).to_numpy()


def run_logs(runs: DataFrame) -> DataFrame:
    """(key, log): log10 probability of the last byte of each run after the others; runs: (key, n), n of the training texts."""
    spark = runs.sparkSession
    top = F.expr(f"(key >> 8) & {(1 << 8 * _TOP) - 1}").alias("top")
    dealt = runs.select(top, "key", "n").repartition("top").sortWithinPartitions("top")

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in _whole_contexts(batches):
            codes, n0, n1, below = _deep_levels(keys, n)[-1].shorter(_TOP - 1)
            yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(n0), pa.array(n1), pa.array(below)], names=["code", "n0", "n1", "below"])

    sums = dealt.where("n > 0").mapInArrow(up, "code long, n0 double, n1 double, below double")
    rows = sums.groupBy("code").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "below")]).toArrow().sort_by("code")
    shallow = [_Level(rows["code"].to_numpy().astype(np.uint64), *[rows[c].to_numpy() for c in ("n0", "n1", "below")])]
    for d in range(_TOP - 2, -1, -1):
        shallow.append(_Level(*shallow[-1].shorter(d)))
    shallow[-1].mix(np.zeros(len(shallow[-1].codes)), np.ones(len(shallow[-1].codes)))
    for level, above in zip(shallow[-2::-1], shallow[:0:-1], strict=True):
        level.mix(above.mixed[level.up], above.free[level.up])
    for level in shallow:
        level.n0 = level.n1 = level.weighted = level.stop = level.one = level.up = None
    shared = spark.sparkContext.broadcast(shallow)

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shallow = shared.value
        for keys, n in _whole_contexts(batches):
            levels = _deep_levels(keys, n)
            at, _ = shallow[0].find(levels[-1].codes & np.uint64((1 << 8 * _TOP) - 1))
            if len(at):
                levels[-1].mix(shallow[0].mixed[at], shallow[0].free[at])
                for level, above in zip(levels[-2::-1], levels[:0:-1], strict=True):
                    level.mix(above.mixed[level.up], above.free[level.up])
            byte, context = keys & np.uint64(255), keys >> np.uint64(8) << np.uint64(8)
            log = np.zeros(len(keys))
            for k in range(8):
                codes = context | (byte | np.uint64(256)) >> np.uint64(8 - k)
                one = np.full(len(keys), 0.5)
                left = np.arange(len(keys))
                for d, level in zip(range(DEPTH, -1, -1), [*levels, *shallow], strict=True):
                    at, ok = level.find(codes[left] & np.uint64((1 << 8 * (d + 1)) - 1))
                    one[left[ok]] = level.mixed[at[ok]] + level.free[at[ok]] * 0.5 if ok.any() else 0.5
                    left = left[~ok]
                    if not len(left):
                        break
                one = np.clip(one, 1e-9, 1 - 1e-9)
                log += np.log10(np.where(byte >> np.uint64(7 - k) & np.uint64(1), one, 1 - one))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(log)], names=["key", "log"])

    return written(dealt.mapInArrow(down, "key long, log double"), "run-logs", 1 << 16)


class _Logs:
    """Values of frequent runs by key, in open addressing: a look-up is a few gathers."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray):
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys, self.logs = np.full(1 << self.bits, _EMPTY), np.zeros(1 << self.bits)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] == _EMPTY
            self.keys[slot[free]] = keys[left[free]]
            won = self.keys[slot] == keys[left]
            self.logs[slot[won]] = logs[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value or 0, whether found)."""
        slot = self._slot(keys)
        there = self.keys[slot]
        known = there == keys
        out = np.where(known, self.logs[slot], 0)
        left = np.flatnonzero(~known & (there != _EMPTY))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            there, asked = self.keys[slot], keys[left]
            hit = there == asked
            known[left[hit]] = True
            out[left[hit]] = self.logs[slot[hit]]
            go = ~hit & (there != _EMPTY)
            left, slot = left[go], slot[go]
        return out, known


_SCORED = "rid long, id long, held_out boolean, n_bytes long, n_tokens long, n_common long, common_log double, score double, rare array<long>, runs array<long>"


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held: int = 2) -> DataFrame:
    """Scores of all rows of docs, under models of those with crc32(id as text) mod modulus other than held.

    bits_per_byte is the code length of a text and its END under the tree, by its bytes and END.
    """
    spark = docs.sparkSession
    crc = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    texts = picked(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), (crc % modulus == held).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counts = written(corpus_counts(texts), "corpus-counts")
    runs = counts.where("kind <> 1").groupBy("key").agg(F.sum(F.when(F.col("kind") == 0, F.col("n")).otherwise(0)).alias("n"), F.sum("n").alias("seen"))
    logs = run_logs(runs)
    places = counts.where("kind <> 1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = runs.where(F.col("seen") >= max(1, -(-places // RUN_SHARE))).select("key")
    near = logs.join(frequent, "key", "left_semi").toArrow()
    tree = spark.sparkContext.broadcast(_Logs(near["key"].to_numpy().astype(np.uint64), near["log"].to_numpy()))
    words = counts.where("kind = 1").select("key", "n")
    size = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    common = words.where(F.col("n") >= max(1, -(-size["n"] // WORD_SHARE))).toArrow()
    keys = common["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    table = spark.sparkContext.broadcast((keys[order], np.log10(common["n"].to_numpy()[order] + 1.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, (keys, logs) = tree.value, table.value
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for piece in B.bind_columns(batch, 2):
                words, first = _word_keys(piece.column(2))
                row = B.row_of(first)
                n = np.diff(first)
                known = np.zeros(len(words), bool)
                log = np.zeros(len(words) + 1)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
                    known = keys[at] == words
                    log[:-1] = np.where(known, logs[at], 0)
                sums = np.bincount(row, log[:-1], minlength=len(n))
                rare = np.concatenate([[0], np.cumsum(~known)])[first]
                data, places, begin = _padded(piece.column(2))
                asked_runs = _runs(data, places)
                score, near = model.find(asked_runs)
                far = np.concatenate([[0], np.cumsum(~near)])[begin]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rid + np.arange(len(n))), piece.column(0), piece.column(1), pa.array(np.diff(begin)), pa.array(n + 1), pa.array(np.bincount(row[known], minlength=len(n))), pa.array(sums),
                        pa.array(np.add.reduceat(score, begin[:-1]) if len(n) else np.empty(0)), pa.ListArray.from_arrays(pa.array(rare, pa.int32()), pa.array(words[~known].view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(far, pa.int32()), pa.array(asked_runs[~near].view(np.int64))),
                    ],
                    names=["rid", "id", "held_out", "n_bytes", "n_tokens", "n_common", "common_log", "score", "rare", "runs"],
                )
                rid += len(n)

    scored = written(texts.select("id", "held_out", "text").mapInArrow(run, _SCORED), "scored")
    asked = scored.select("rid", F.explode("rare").alias("key"))
    found = asked.join(words, "key").groupBy("rid").agg(F.count("*").alias("n_rare"), F.sum(F.log10(F.col("n") + 1)).alias("rare_log"))
    far = scored.select("rid", F.explode("runs").alias("key")).join(logs, "key").groupBy("rid").agg(F.sum("log").alias("far"))
    ends = words.where(F.col("key") == END_KEY).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    each = float(np.log10(size["n"] + size["v"] + 1))
    end_log = float(np.log10(ends + 1))
    return scored.drop("rare", "runs").join(found, "rid", "left").join(far, "rid", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_common") + F.coalesce("n_rare", F.lit(0)) + int(ends > 0)).alias("n_known"), F.lit(int(size["n"])).cast("long").alias("train_tokens"),
        (F.col("common_log") + F.coalesce("rare_log", F.lit(0.0)) + end_log - F.col("n_tokens") * each).alias("base_score"), (F.col("score") + F.coalesce("far", F.lit(0.0))).alias("score"),
        (-(F.col("score") + F.coalesce("far", F.lit(0.0))) * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op6_context_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
