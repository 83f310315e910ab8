"""Ranked lexical search: an inverted index by shards, documents scored one after the other, the best kept in heaps.

1. A task gathers documents until their texts take SHARD_BYTES, orders them by doc_id and makes one row of the index:
   the documents with their lengths, the terms, and for each term the documents that hold it, ascending, with counts. A
   list holds gaps between documents, and counts, in as few bytes each as its largest needs. Terms of 16 bytes at most
   are two whole numbers, longer ones stand in a list of their own: terms are never told apart by a hash alone.
2. How many documents hold a term is summed over the shards for the terms of a block of queries.
3. A task goes through its shards. For a query, a heap holds a cursor into the list of each of its terms, keyed by the
   next document. A window of documents begins where the first cursor stands; the cursors before its end are popped and
   add what their documents score, then the window's documents are finished and offered to the query's heap of results,
   which holds as many as are asked for, keyed by score and doc_id, and lasts over all shards of the task.
4. The heaps' rows meet by query, cut to the best within each task first.

All scores are 64-bit integers, but for the logarithm in a term's weight. Memory: a shard and a block of queries.

Defined cases: a null text is in no result and counts for nothing; neither does a text without terms; queries without
terms have no rows; rows of equal doc_id are documents of their own; of equal scores the smaller doc_id is first, null
last; repeated queries are ranked each for itself; a text of any length is in one shard; an empty table on either side
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush, heappushpop, heapreplace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytesops as B
from .rows import picked
from .scratch import written

SHARD_BYTES = 8 << 20
#: Bytes of the queries that are searched in one pass.
BLOCK_BYTES = 4 << 20
WINDOW = 4096
_LONG = np.uint64(0xFFFFFFFFFFFFFFFF)


# terms


def term_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, longer: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Two whole numbers for each term: its bytes, or its place in `longer` and 2^64 - 1, which no UTF-8 text is."""
    size = ends - starts
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    both = []
    for base in (0, 8):
        out = np.zeros(len(starts), np.uint64)
        at = np.flatnonzero(size > base)
        for k in range(base, base + 8):
            at = at[size[at] > k]
            out[at] |= padded[starts[at] + k].astype(np.uint64) << np.uint64(8 * (k - base))
        both.append(out)
    low, high = both
    for i in np.flatnonzero(size > 16):
        low[i] = longer.setdefault(data[starts[i] : ends[i]].tobytes(), len(longer))
        high[i] = _LONG
    return low, high


def _order(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return B.mix(low ^ B.mix(high + np.uint64(0x632BE59BD9B4E019)))


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends, first) of the terms of texts."""
    data, offsets = B.text_bytes(column)
    data = B.LOWER[data]
    return data, *B.word_spans(data, offsets, B.ALNUM)


# the index

INDEX = "n_docs long, n_terms long, ids binary, no_id binary, sizes binary, low binary, high binary, longer array<binary>, df binary, widths binary, postings binary"
_DICTIONARY = ("low", "high", "longer", "df")


def _packed(values: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Each value in its width of bytes, little-endian."""
    at = np.cumsum(width) - width
    out = np.empty(int(width.sum()), np.uint8)
    for k in range(4):
        some = np.flatnonzero(width > k)
        out[at[some] + k] = values[some] >> (8 * k) & 255
    return out


def _width(most: np.ndarray) -> np.ndarray:
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))


def shard(ids: pa.Array, texts: pa.Array) -> dict | None:
    """One row of the index; None if no text has a term."""
    none = ids.is_null().to_numpy(zero_copy_only=False)
    number = ids.fill_null(0).to_numpy(zero_copy_only=False)
    order = np.lexsort((number, none))
    data, starts, ends, first = _texts(texts.take(pa.array(order)))
    n = np.diff(first)
    filled = np.flatnonzero(n)
    if not len(filled):
        return None
    longer: dict[bytes, int] = {}
    low, high = term_keys(data, starts, ends, longer)
    doc = np.repeat(np.arange(len(filled)), n[filled])
    key = _order(low, high)
    by = np.argsort(key, kind="stable")
    differs = lambda x: x[by[1:]] != x[by[:-1]]
    other = differs(low) | differs(high)
    if (other & ~differs(key)).any():
        by = np.lexsort((high, low, key))
        other = differs(low) | differs(high)
    # a posting for each run of one term in one document
    cut = np.flatnonzero(np.concatenate([[True], other | differs(doc)]))
    count = np.diff(np.append(cut, len(by)))
    term_starts = np.flatnonzero(np.concatenate([[True], other])[cut])
    df = np.diff(np.append(term_starts, len(cut)))
    docs = doc[by[cut]]
    gaps = np.diff(docs, prepend=0)
    gaps[term_starts] = docs[term_starts]
    widths = np.stack([_width(np.maximum.reduceat(x, term_starts)) for x in (gaps, count)], 1)
    # for each term its gaps and then its counts
    both = np.concatenate([gaps, count])
    place = np.repeat(np.cumsum(df) - df, df)
    own = np.arange(len(cut)) - place
    target = np.concatenate([2 * place + own, 2 * place + np.repeat(df, df) + own])
    mixed, wide = np.empty_like(both), np.empty_like(both)
    mixed[target], wide[target] = both, np.concatenate([np.repeat(widths[:, 0], df), np.repeat(widths[:, 1], df)])
    terms = by[cut[term_starts]]
    kept = order[filled]
    return {
        "n_docs": len(filled), "n_terms": len(by), "ids": number[kept].astype("<i8").tobytes(), "no_id": none[kept].astype(np.uint8).tobytes(), "sizes": n[filled].astype("<i8").tobytes(), "low": low[terms].tobytes(), "high": high[terms].tobytes(),
        "longer": list(longer), "df": df.astype("<i4").tobytes(), "widths": widths.astype(np.uint8).tobytes(), "postings": _packed(mixed, wide).tobytes(),
    }


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of docs, one row for each shard, written in the shared folder."""
    source = picked(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def made() -> Iterator[pa.RecordBatch]:
            row = shard(*(pa.concat_arrays([b.column(k).cast(t) for b in held]) for k, t in ((0, pa.int64()), (1, pa.large_string()))))
            held.clear()
            if row is not None:
                yield pa.RecordBatch.from_arrays([pa.array([row[c]], pa.int64() if c.startswith("n_") else pa.list_(pa.binary()) if c == "longer" else pa.binary()) for c in row], names=list(row))

        for batch in batches:
            for piece in B.bind_columns(batch, 1, min(shard_bytes, B.PIECE_BYTES)):
                held.append(piece)
                size += pc.sum(pc.binary_length(piece.column(1))).as_py() or 0
                if size >= shard_bytes:
                    yield from made()
                    size = 0
        if held:
            yield from made()

    return written(source.mapInArrow(run, INDEX), "lexical-index")


class Shard:
    """A row of the index, or its dictionary, as arrays."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        column = lambda c: memoryview(batch.column(batch.schema.get_field_index(c))[row].as_buffer())
        self.low, self.high = (np.frombuffer(column(c), np.uint64) for c in ("low", "high"))
        self.key = _order(self.low, self.high)
        self.longer = batch.column(batch.schema.get_field_index("longer"))[row].values
        self.df = np.frombuffer(column("df"), "<i4").astype(np.int64)
        if "postings" in batch.schema.names:
            self.ids, self.sizes = (np.frombuffer(column(c), "<i8") for c in ("ids", "sizes"))
            self.no_id = np.frombuffer(column("no_id"), np.uint8)
            self.widths = np.frombuffer(column("widths"), np.uint8).reshape(-1, 2).astype(np.int64)
            self.postings = column("postings")
            self.at = np.concatenate([[0], np.cumsum(self.df * self.widths.sum(1))])

    def find(self, wanted: Terms) -> np.ndarray:
        """The place of each term in the dictionary, -1 where it isn't there."""
        low = wanted.low
        if len(wanted.longer):
            place = pc.index_in(wanted.longer, value_set=self.longer)
            there = place.is_valid().to_numpy(zero_copy_only=False)
            low = low.copy()
            low[wanted.high == _LONG] = np.where(there, place.fill_null(0).to_numpy(zero_copy_only=False), -1).astype(np.int64).view(np.uint64)
        key = _order(low, wanted.high)
        at = np.searchsorted(self.key, key)
        out = np.full(len(at), -1)
        while True:
            live = np.flatnonzero((out < 0) & (at < len(self.key)))
            live = live[self.key[at[live]] == key[live]]
            if not len(live):
                return out
            same = live[(self.low[at[live]] == low[live]) & (self.high[at[live]] == wanted.high[live])]
            out[same] = at[same]
            at[live] += 1

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, ascending, how often each holds the term)."""
        n, (gap, count), at = self.df[term], self.widths[term], self.at[term]
        docs = np.cumsum(np.frombuffer(self.postings, f"<u{gap}", n, at), dtype=np.int64)
        return docs, np.frombuffer(self.postings, f"<u{count}", n, at + n * gap).astype(np.int64)


# queries


@dataclass
class Terms:
    """The terms of a block of queries, and for each query (place of the term, how often) and its id."""

    low: np.ndarray
    high: np.ndarray
    longer: pa.Array
    queries: list[list[tuple[int, int]]]
    ids: pa.Array


def _terms(ids: pa.Array, texts: pa.Array) -> Terms:
    data, starts, ends, first = _texts(texts)
    longer: dict[bytes, int] = {}
    low, high = term_keys(data, starts, ends, longer)
    places: dict[tuple[int, int], int] = {}
    every = [places.setdefault(k, len(places)) for k in zip(low.tolist(), high.tolist(), strict=True)]
    counts = [sorted(Counter(every[a:b]).items()) for a, b in zip(first[:-1], first[1:], strict=True)]
    own = np.array(list(places), np.uint64).reshape(-1, 2)
    # longer terms stand in the order in which they were met, in places as in the list
    return Terms(own[:, 0].copy(), own[:, 1].copy(), pa.array(list(longer), pa.binary()), counts, ids)


def _blocks(queries: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[Terms]:
    """The queries in blocks of about so many bytes, in which each is whole."""
    source = picked(queries, id_col, text_col).toDF("id", "text").withColumn("text", F.col("text").cast("string")).where("text IS NOT NULL")
    n = -(-(source.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes)
    for k in range(n):
        block = source.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).toArrow().combine_chunks()
        if block.num_rows:
            yield _terms(*(block.column(c).combine_chunks() if isinstance(block.column(c), pa.ChunkedArray) else block.column(c) for c in ("id", "text")))


def _best(shard: Shard, terms: Terms, weights: np.ndarray, n_docs: int, n_terms: int, limit: int, heaps: list[list]) -> None:
    """Offer the documents of a shard to the heap of each query."""
    place = shard.find(terms)
    most = 75 * int(shard.sizes.max()) * n_docs
    sizes = shard.sizes if most < 1 << 63 else shard.sizes.astype(object)
    m = (25 + 75 * sizes * n_docs // n_terms).astype(np.int64)
    lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for t in np.flatnonzero((place >= 0) & (weights > 0)):
        docs, count = shard.list_of(place[t])
        lists[int(t)] = docs, weights[t] * (1_000_000_000 * count // (1000 * count + 8 * m[docs]))
    scores = np.zeros(WINDOW, np.int64)
    for query, best in zip(terms.queries, heaps, strict=True):
        cursors = [(int(lists[t][0][0]), t, times, 0) for t, times in query if t in lists]
        heapify(cursors)
        while cursors:
            base = cursors[0][0]
            scores[:] = 0
            while cursors and cursors[0][0] < base + WINDOW:
                _, t, times, at = cursors[0]
                docs, value = lists[t]
                to = at + int(np.searchsorted(docs[at:], base + WINDOW))
                scores[docs[at:to] - base] += value[at:to] * times
                if to < len(docs):
                    heapreplace(cursors, (int(docs[to]), t, times, to))
                else:
                    heappop(cursors)
            found = np.flatnonzero(scores >= (max(best[0][0], 1) if len(best) == limit else 1))
            for d in found[np.argsort(-scores[found], kind="stable")[:limit]]:
                doc = base + int(d)
                own = (int(scores[d]), -int(shard.no_id[doc]), -int(shard.ids[doc]))
                if len(best) < limit:
                    heappush(best, own)
                else:
                    heappushpop(best, own)


def ranked(index: DataFrame, queries: DataFrame, limit: int = 10, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query id, rank, doc_id, score): for each query the documents of highest score above 0, `limit` at most."""
    spark = index.sparkSession
    kind = picked(queries, id_col).schema[0].dataType
    schema = f"query long, id {kind.simpleString()}, doc_id long, score long"
    totals = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = totals[0] or 0, totals[1] or 0
    out = None
    for terms in _blocks(queries, id_col, text_col, block_bytes) if n_docs else ():
        held = spark.sparkContext.broadcast(terms)

        def counted(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            wanted = held.value
            total = np.zeros(len(wanted.low), np.int64)
            for batch in batches:
                for row in range(batch.num_rows):
                    one = Shard(batch, row)
                    at = one.find(wanted)
                    total[at >= 0] += one.df[at[at >= 0]]
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["term", "df"])

        df = np.zeros(len(terms.low), np.int64)
        for term, n in index.select(*_DICTIONARY).mapInArrow(counted, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
            df[term] = n
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)

        def searched(batches: Iterator[pa.RecordBatch], held=held, weights=weights) -> Iterator[pa.RecordBatch]:
            wanted = held.value
            heaps: list[list] = [[] for _ in wanted.queries]
            for batch in batches:
                for row in range(batch.num_rows):
                    _best(Shard(batch, row), wanted, weights, n_docs, n_terms, limit, heaps)
            query = np.repeat(np.arange(len(heaps)), [len(h) for h in heaps])
            rows = [x for h in heaps for x in h]
            doc = pa.array([None if none else -i for _, none, i in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(query), wanted.ids.take(pa.array(query)), doc, pa.array([x[0] for x in rows], pa.int64())], names=["query", "id", "doc_id", "score"])

        rows = index.mapInArrow(searched, schema)
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        block = rows.withColumn("rank", place).where(F.col("rank") <= limit).select("id", "rank", "doc_id", "score")
        out = block if out is None else out.unionAll(block)
    if out is None:
        out = spark.createDataFrame([], schema).select("id", F.lit(0).alias("rank"), "doc_id", "score")
    return out.withColumnRenamed("id", id_col)


LIMIT = 10


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return ranked(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), LIMIT).select("item_id", "rank", "doc_id", "score")


_W = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP13_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_W} AS ws FROM documents),
b AS MATERIALIZED (SELECT row_number() OVER () AS iid, item_id, {_W} AS ws FROM benchmark),
bt AS (SELECT iid, w, count(*) AS times FROM (SELECT iid, unnest(ws) AS w FROM b) GROUP BY 1, 2),
dt AS MATERIALIZED (SELECT rid, w, count(*) AS tf FROM (SELECT rid, unnest(ws) AS w FROM d) GROUP BY 1, 2),
n AS (SELECT rid, doc_id, len(ws) AS n FROM d WHERE len(ws) > 0), g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
f AS (SELECT w, count(*) AS df FROM dt WHERE w IN (SELECT w FROM bt) GROUP BY 1),
s AS (SELECT iid, rid, any_value(doc_id) AS doc_id, CAST(sum(times * CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
    FROM bt JOIN f USING (w) JOIN dt USING (w) JOIN n USING (rid), g GROUP BY 1, 2)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS place FROM s WHERE score > 0) JOIN b USING (iid) WHERE place <= {LIMIT}
"""
