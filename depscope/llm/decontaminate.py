"""Benchmark decontamination: an FM-index per training shard, searched backwards for the test phrases.

Words are maximal runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after lower-casing A-Z, compared by 64 bits of hash. A phrase is
`window` consecutive words of an item; an item with fewer words, but not none, is one phrase. A task cuts its documents
into shards of SHARD_BYTES of text. All words of a shard become symbols of its own vocabulary, with a separator after
each document, and are indexed once: suffix sort, wavelet ranks, sampled positions. Backward search finds the range of
every phrase, places come from the sampled suffixes, and the words that they cover merge into removal spans.

The benchmark is a stated query set. It passes through the driver in blocks of BLOCK_WORDS words, one in memory at a
time and broadcast alone: a pass over the documents marks what one block finds, and between passes the marks are
written to the shared folder and the block is given back. One block, as here, is one pass without any shuffle.

Defined cases: null or wordless texts have no words and no hits; items with a null id or no word are skipped;
repeated item ids count once, repeated documents are judged row by row; a long text is a shard of its own; either table
may be empty. Columns of any name are carried along; one with the name of a new column, in any case, is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesops as B
from .fm_index import FMIndex
from .rows import numbered, picked, place_of, renewed
from .scratch import release, written

SHARD_BYTES = 4 << 20
BLOCK_WORDS = 1 << 20

FIELDS = [
    *(T.StructField(n, T.LongType()) for n in ("n_words", "n_hit", "n_items")),
    T.StructField("items", T.ArrayType(T.StringType(), False)),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]), False)),
    T.StructField("cleaned", T.StringType()),
]
#: What one pass leaves for the next: hit words as starts and ends in turn, and the items found.
_STATE = [T.StructField("hits", T.ArrayType(T.LongType(), False)), T.StructField("items", T.ArrayType(T.StringType(), False))]


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, first) of the words, and the texts' offsets."""
    data, off = B.text_bytes(texts)
    data = B.LOWER[data]
    starts, ends, first = B.word_spans(data, off, B.ALNUM)
    return B.span_hash(B.prefix_hash(data), starts, ends), starts, ends, first, off


class Phrases:
    """A block of items: its vocabulary, its distinct phrases as right-aligned symbols, and the items of each phrase."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        h, _, _, first, _ = _words(pa.array(texts, pa.string()))
        self.vocabulary = np.unique(h)
        symbols = np.searchsorted(self.vocabulary, h) + 1
        n = np.diff(first)
        count = np.where(n >= window, n - window + 1, np.minimum(n, 1))
        item = np.repeat(np.arange(len(n)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[:-1], count)
        length = np.repeat(np.minimum(n, window), count)
        place = np.arange(window) - (window - length)[:, None]
        symbols = np.append(symbols, 0).astype(np.int32)
        rows = np.where(place >= 0, symbols[np.minimum(at[:, None] + np.maximum(place, 0), len(symbols) - 1)], 0).astype(np.int32)
        self.patterns, self.which = np.unique(rows, axis=0, return_inverse=True)
        self.which = self.which.reshape(-1)
        self.lengths = (self.patterns > 0).sum(axis=1)
        order = np.argsort(self.which, kind="stable")
        self.item_first = np.searchsorted(self.which[order], np.arange(len(self.patterns) + 1))
        self.item_of = item[order]
        self.ids = ids


def phrase_blocks(benchmark: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> Iterator[Phrases]:
    ids: list[str] = []
    texts: list[str] = []
    held = 0
    rows = picked(benchmark, id_col, text_col).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    for r in rows.toLocalIterator():
        ids.append(r["id"])
        texts.append(r["text"])
        held += len(r["text"]) // 4 + 1
        if held >= BLOCK_WORDS:
            yield Phrases(ids, texts, window)
            ids, texts, held = [], [], 0
    if ids:
        yield Phrases(ids, texts, window)


class Shard:
    """The words of some pieces of text and the FM-index over all of them."""

    def __init__(self, pieces: list[pa.RecordBatch], at: int):
        self.found = [_words(p.column(at)) for p in pieces]
        words = np.concatenate([x[0] for x in self.found])
        self.base = np.cumsum([0, *(len(x[0]) for x in self.found)])
        self.first = np.concatenate([[0], *(x[3][1:] + b for x, b in zip(self.found, self.base, strict=False))])
        self.vocabulary, symbols = np.unique(words, return_inverse=True)
        # a separator after each document
        self.place = np.arange(len(words)) + B.row_of(self.first)
        sequence = np.zeros(len(words) + len(self.first) - 1, np.int64)
        sequence[self.place] = symbols + 1
        self.index = FMIndex(sequence) if len(words) else None

    def search(self, block: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """(first word, phrase) of every occurrence of the block's phrases."""
        if self.index is None or not len(block.patterns):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, block.vocabulary), len(self.vocabulary) - 1)
        symbol = np.append(0, np.where(self.vocabulary[at] == block.vocabulary, at + 1, 0))
        # a phrase with a word that the shard does not hold is not in it
        here = np.flatnonzero(((symbol[block.patterns] > 0) == (block.patterns > 0)).all(axis=1))
        low, high = self.index.search(symbol[block.patterns[here]], block.lengths[here])
        n = np.maximum(high - low, 0)
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        return np.searchsorted(self.place, self.index.locate(rows)), np.repeat(here, n)


def _shards(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for batch in batches:
        for piece in B.bind_columns(batch, at):
            held.append(piece)
            size += piece.column(at).nbytes
            if size >= SHARD_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _runs(mine: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) word of each maximal run of hit words; runs end with their document."""
    begin, finish = mine.copy(), mine.copy()
    begin[1:] &= ~mine[:-1]
    cut = own[1:-1][own[1:-1] < len(mine)]
    begin[cut] = mine[cut]
    finish[:-1] &= ~mine[1:]
    cut = own[1:-1][own[1:-1] > 0] - 1
    finish[cut] = mine[cut]
    return np.flatnonzero(begin), np.flatnonzero(finish)


def _marked(pieces: list[pa.RecordBatch], at: int, block: Phrases | None, with_text: bool, last: bool) -> Iterator[list[pa.Array]]:
    """For each piece of one shard the columns FIELDS, or _STATE if more blocks follow. Columns at + 1 and at + 2, if there, are _STATE."""
    shard = Shard(pieces, at)
    first = shard.first
    cover = np.zeros(first[-1] + 1, np.int64)
    items: dict[int, set[str]] = {}
    if pieces[0].num_columns > at + 1:
        row = 0
        for piece in pieces:
            for hits, names in zip(piece.column(at + 1).to_pylist(), piece.column(at + 2).to_pylist(), strict=True):
                np.add.at(cover, np.array(hits[::2], np.int64) + first[row], 1)
                np.add.at(cover, np.array(hits[1::2], np.int64) + first[row], -1)
                if names:
                    items[row] = set(names)
                row += 1
    if block is not None:
        start, phrase = shard.search(block)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + block.lengths[phrase], -1)
        doc = np.searchsorted(first, start, side="right") - 1
        for d, p in np.unique(np.stack([doc, phrase], axis=1), axis=0) if len(doc) else ():
            items.setdefault(int(d), set()).update(block.ids[i] for i in block.item_of[block.item_first[p] : block.item_first[p + 1]])
    hit = np.cumsum(cover[:-1]) > 0
    n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[first])
    row = 0
    for piece, (_, starts, ends, own, off), b in zip(pieces, shard.found, shard.base, strict=False):
        n = piece.num_rows
        s, e = _runs(hit[b : b + len(starts)], own)
        span_first = np.searchsorted(s, own)
        doc = np.searchsorted(own, s, side="right") - 1
        names = pa.array([sorted(items.get(row + i, ())) for i in range(n)], pa.list_(pa.string()))
        if not last:
            pairs = np.stack([s - own[doc], e + 1 - own[doc]], axis=1).reshape(-1)
            yield [pa.ListArray.from_arrays(pa.array(2 * span_first, pa.int32()), pa.array(pairs, pa.int64())), names]
            row += n
            continue
        left, right = starts[s] - off[doc], ends[e] - off[doc]
        cleaned = pa.nulls(n, pa.string())
        if with_text:
            texts = piece.column(at).to_pylist()
            for i in np.flatnonzero(np.diff(span_first)):
                raw, parts, done = texts[i].encode(), [], 0
                for k in range(span_first[i], span_first[i + 1]):
                    parts.append(raw[done : left[k]])
                    done = right[k]
                texts[i] = b"".join([*parts, raw[done:]]).decode()
            cleaned = pa.array(texts, pa.string())
        yield [
            pa.array(np.diff(own)), pa.array(n_hit[row : row + n]), pa.array(np.diff(names.offsets.to_numpy()).astype(np.int64)), names,
            pa.ListArray.from_arrays(pa.array(span_first, pa.int32()), pa.StructArray.from_arrays([pa.array(left), pa.array(right)], names=["start", "end"])),
            cleaned,
        ]
        row += n


def _pass(source: DataFrame, n: int, block, with_text: bool, last: bool) -> DataFrame:
    """source has n columns to carry, the text, and after the first pass _STATE. block: a broadcast of Phrases, or None."""
    carried = n if last else n + 1
    schema = T.StructType([*source.schema.fields[:carried], *[T.StructField(f"v_{f.name}", f.dataType) for f in (FIELDS if last else _STATE)]])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces in _shards(batches, n):
            for piece, made in zip(pieces, _marked(pieces, n, block.value if block else None, with_text, last), strict=True):
                yield pa.RecordBatch.from_arrays([*piece.columns[:carried], *made], names=names)

    return source.mapInArrow(run, schema)


def _all_passes(docs: DataFrame, places: list[int], text: str, benchmark: DataFrame, window: int, with_text: bool) -> DataFrame:
    """Columns c<place>, then v_<field>."""
    source = numbered(docs).select(*[F.col(f"c{i}") for i in places], F.col(f"c{place_of(docs, text)}").cast("string").alias("text"))
    blocks = phrase_blocks(benchmark, window)
    block, following = next(blocks, None), next(blocks, None)
    before = None
    while following is not None:
        shared = docs.sparkSession.sparkContext.broadcast(block)
        source = written(_pass(source, len(places), shared, with_text, False), "decontamination-marks")
        shared.unpersist()
        if before is not None:
            release(before)
        before, block, following = source, following, next(blocks, None)
    return _pass(source, len(places), docs.sparkSession.sparkContext.broadcast(block) if block else None, with_text, True)


def mark_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", keep: list[str] | None = None, with_text: bool = True) -> DataFrame:
    """docs with the columns FIELDS: hit words, items found, byte spans to remove, and (with_text) the text without them."""
    new = {f.name for f in FIELDS}
    places = [i for i in (range(len(docs.columns)) if keep is None else [place_of(docs, c) for c in keep]) if docs.columns[i].lower() not in new]
    return _all_passes(docs, places, text, benchmark, window, with_text).toDF(*[docs.columns[i] for i in places], *[f.name for f in FIELDS])


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text") -> DataFrame:
    """docs without the words that benchmark phrases cover, with the columns of docs, whatever their names."""
    made = _all_passes(docs, list(range(len(docs.columns))), text, benchmark, window, True)
    return made.select(*renewed(docs, place_of(docs, text), F.col("v_cleaned"))).toDF(*docs.columns)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = mark_contamination(docs, benchmark, keep=["doc_id"], with_text=False)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_W = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP4_SQL = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_W} AS ws FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, array_to_string(list_slice(ws, i, i + 9), ' ') AS g, least(len(ws), 10) AS n
    FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS rid, doc_id, {_W} AS ws FROM documents),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS g FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
occ AS (SELECT rid, i, dw.n, item_id FROM dw JOIN bw USING (g, n)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM occ) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT rid, item_id FROM occ) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""
