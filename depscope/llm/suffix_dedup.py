"""Suffix-array dedup: remove every byte covered by a string of `length` bytes that starts anywhere else as well.

Suffixes are sorted by bucket-pointer refinement, to the depth of `length` bytes, in blocks that hold together all
places where equal strings can be:

1. Each string of `length` bytes elects an anchor, the ANCHOR-byte string of least hash inside it (leftmost of equal
   ones), so equal strings elect equal anchors. Neighbouring strings with one anchor form a region, about 70 bytes apart.
2. Anchors are counted by their hash. Regions whose anchor stands once hold nothing repeated and go no further.
3. Regions are keyed by anchor and content, and counted with partial sums in each task: all strings of a region
   found twice are repeated. Equal regions go on as one.
4. Where regions share an anchor but not all their bytes, one text of each is sorted: suffixes start in buckets of
   their first 7 bytes, and a bucket is refined by the bucket pointers of later offsets; what a bucket has become is
   reused by those after it. A string is repeated if a neighbour in the order has its `length` bytes.
5. Regions of an anchor with very many kinds are first cut into parts of strings that share most of their bytes, and
   parts are keyed by those bytes, counted and sorted as regions are.
6. The covered bytes of a document merge into removal spans.

Only counts reach the driver. Small lists of ids and anchors are broadcast after their rows are counted, else joined by
shuffles. Matches never cross documents, as regions don't. A block is cut between anchors, or parts, never within one.

Defined cases: a null text is empty; shorter texts lose nothing; equal rows are places of their own, so both lose
what they share; ids may repeat or be null; a text of any length is one row; extra columns, of any name, are
kept out of the way; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B
from .rows import picked
from .scratch import if_small, written

LENGTH = 200
ANCHOR = 64
BLOCK_BYTES = 1 << 19
#: Ranges of ranks that are refined one after the other, within a block.
PASSES = 16
#: Regions of an anchor with more kinds than this are split before they are sorted.
HOT_KINDS = 512
#: Kinds found at more places than this are joined by broadcast.
HOT_PLACES = 512
_WHOLE = 1 << 40
BROADCAST_ROWS = 2_000_000


def _least_in_window(keys: np.ndarray, w: int) -> np.ndarray:
    """Least of keys[p : p + w] for each p that has so many, from running minima of blocks."""
    n = len(keys)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def regions(data: np.ndarray, off: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(row, start, end, anchor hash, content hash) of the regions of some texts; start and end are bytes of the text."""
    empty = np.empty(0, np.int64)
    starts = [np.arange(a, b - length + 1) for a, b in zip(off[:-1], off[1:], strict=True) if b - a >= length]
    if not starts:
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    p = np.concatenate(starts)
    sums = B.prefix_hash(data)
    grams = B.window_hash(sums, anchor)
    bits = np.uint64(max(22, int(len(grams)).bit_length()))
    keys = grams >> bits << bits | np.arange(len(grams), dtype=np.uint64)
    at = (_least_in_window(keys, length - anchor + 1)[p] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(p), bool)
    new[1:] = (at[1:] != at[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    begin, end = p[first], p[last] + length
    row = np.searchsorted(off, begin, side="right") - 1
    return row, begin - off[row], end - off[row], grams[at[first]], B.span_hash(sums, begin, end)


def repeated_suffixes(text: np.ndarray, ends: np.ndarray, length: int, passes: int = PASSES) -> np.ndarray:
    """Places whose first `length` bytes are found at another place too. ends: each place's end of region.

    Bucket-pointer refinement. A bucket's pointer is the rank of its first suffix, its depth the bytes on which its
    suffixes agree. The first buckets are those of the first bytes; they are refined a range of ranks at a time, each
    until its buckets hold one suffix or agree on `length` bytes. A bucket of depth d is sorted by the pointers of the
    suffixes d bytes later and is then as much deeper as the bucket it was sorted by, so that later ranges go by what
    earlier ones have refined. The end of a region is less than every byte. Pointers may tell suffixes apart by bytes
    beyond `length`, so neighbours in the final order are compared by their bytes.
    """
    n = len(text)
    left = ends - np.arange(n)
    q = min(7, length)
    word = np.minimum(left, q).astype(np.uint64)
    for k in range(q):
        inside = left[: n - k] > k
        word[: n - k][inside] |= text[k:][inside].astype(np.uint64) << np.uint64(8 * (7 - k))
    order = np.argsort(word)
    ranked = word[order]
    new = np.ones(n, bool)
    new[1:] = ranked[1:] != ranked[:-1]
    heads = np.flatnonzero(new)
    pointer = np.empty(n, np.int64)
    pointer[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    depth = np.where(left >= q, q, _WHOLE)

    cuts = heads[np.searchsorted(heads, np.arange(1, passes) * n // passes, side="left").clip(max=len(heads) - 1)] if n else heads
    edges = np.unique(np.concatenate([[0], cuts, [n]]))
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        at = np.arange(low, high)
        while len(at):
            # `at` are the ranks of whole buckets
            x = order[at]
            old = pointer[x]
            size = np.bincount(old - low, minlength=1)[old - low]
            x = x[(size > 1) & (depth[x] < length)]
            if not len(x):
                break
            old = pointer[x]
            target = x + depth[x]
            inside = target < ends[x]
            target = np.where(inside, target, x)
            key = np.where(inside, pointer[target] + 1, 0)
            deeper = np.where(inside, np.minimum(depth[x] + depth[target], _WHOLE), _WHOLE)
            by = np.argsort(old * (n + 1) + key)
            x, old, key, deeper = x[by], old[by], key[by], deeper[by]
            bucket = np.ones(len(x), bool)
            bucket[1:] = old[1:] != old[:-1]
            part = bucket.copy()
            part[1:] |= key[1:] != key[:-1]
            i = np.arange(len(x))
            start = np.maximum.accumulate(np.where(bucket, i, 0))
            at = old + i - start
            order[at] = x
            pointer[x] = old + np.maximum.accumulate(np.where(part, i, 0)) - start
            depth[x] = deeper

    full = left[order] >= length
    a, b = order[:-1], order[1:]
    pair = np.flatnonzero(full[:-1] & full[1:])
    same = (pointer[a[pair]] == pointer[b[pair]]) & (depth[a[pair]] >= length)
    open_ = pair[~same]
    for step in [*range(0, length - q, q), length - q]:
        open_ = open_[word[a[open_] + step] == word[b[open_] + step]]
    equal = np.zeros(n + 1, bool)
    equal[pair[same] + 1] = True
    equal[open_ + 1] = True
    return np.sort(order[(equal[:-1] | equal[1:])[:n]])


def _sorted_spans(rows: list[tuple], length: int) -> pa.RecordBatch:
    """Spans of repeated strings in a block of regions (id, key, start, bytes)."""
    text = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
    size = np.array([len(r[3]) for r in rows])
    base = np.cumsum(size) - size
    place = repeated_suffixes(text, np.repeat(base + size, size), length)
    row = np.searchsorted(base, place, side="right") - 1
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1] + 1) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place))[: len(first)] - 1
    start = np.array([r[2] for r in rows], np.int64)[row[first]] - base[row[first]] + place[first]
    end = start + place[last] - place[first] + length
    return pa.RecordBatch.from_arrays([pa.array([rows[i][k] for i in row[first]], pa.int64()) for k in (0, 1)] + [pa.array(start), pa.array(end)], names=["id", "key", "start", "end"])


def _bytes_of(source: DataFrame, regions_: DataFrame) -> DataFrame:
    """(id, key, anchor, start, bytes) of regions (anchor, key, id, start, end), read from the rows (id, key, text)."""
    by_text = written(regions_.groupBy("id", "key").agg(F.collect_list(F.struct("anchor", "start", "end")).alias("regions")), "partial-regions")
    holders = by_text.select(F.col("id").alias("h_id"), F.col("key").alias("h_key"))
    same = F.col("id").eqNullSafe(F.col("h_id")) & (F.col("key") == F.col("h_key"))
    held = source.join(if_small(holders, BROADCAST_ROWS), same, "left_semi").dropDuplicates(["id", "key"]).withColumnsRenamed({"id": "h_id", "key": "h_key"})
    raw = held.join(by_text, same).select("id", "key", F.encode("text", "utf-8").alias("raw"), F.explode("regions").alias("r"))
    return raw.select("id", "key", F.col("r.anchor").alias("anchor"), F.col("r.start").alias("start"), F.expr("substring(raw, r.start + 1, r.end - r.start)").alias("bytes"))


def _split(batches: Iterator[pa.RecordBatch], length: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """Parts (id, key, anchor, content, start, end, bytes) of regions (id, key, anchor, start, bytes).

    A part holds the strings whose starts are within some bytes of each other, counted from the anchor. All of them
    hold the same stretch around the anchor, whose hash is the part's new anchor: equal strings are in equal parts.
    """
    width = max(1, (length - anchor) // 8)
    for batch in batches:
        for piece in B.bind_columns(batch, 4):
            data, off = B.text_bytes(piece.column(4))
            known = piece.column(2).to_numpy().view(np.uint64)
            row = np.repeat(np.arange(len(known)), np.diff(off))
            sums = B.prefix_hash(data)
            grams = B.window_hash(sums, anchor)
            found = np.flatnonzero(grams == known[row[: len(grams)]])
            found = found[found + anchor <= off[row[found] + 1]]
            at = np.empty(len(known), np.int64)
            at[row[found][::-1]] = found[::-1]  # the first one of each region
            for g in range((length - anchor) // width + 1):
                low, high = at - g * width - width + 1, at - g * width
                first, last = np.maximum(low, off[:-1]), np.minimum(high, off[1:] - length)
                use = np.flatnonzero(first <= last)
                if not len(use):
                    continue
                begin, end = first[use], last[use] + length
                around = B.span_hash(sums, high[use], low[use] + length)
                new = B.mix(around + known[use] + np.uint64(g))
                content = B.span_hash(sums, begin, end)
                start = piece.column(3).to_numpy()[use] - off[use]
                columns = [piece.column(k).take(pa.array(use)) for k in (0, 1)]
                columns += [pa.array(new.view(np.int64)), pa.array(content.view(np.int64)), pa.array((start + begin).astype(np.int32)), pa.array((start + end).astype(np.int32))]
                columns.append(pa.array([data[i:j].tobytes() for i, j in zip(begin, end, strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "anchor", "content", "start", "end", "bytes"])


def repeated_spans(texts: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(id, key, start, end) of repeated strings, overlapping and in no order, for rows (id, key, text)."""

    def found(batches: Iterator[pa.RecordBatch], only: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in B.bind_columns(batch, 2):
                data, off = B.text_bytes(piece.column(2))
                row, start, end, a, content = regions(data, off, length, anchor)
                columns = [pa.array(a.view(np.int64))]
                if not only:
                    columns += [pa.array(content.view(np.int64)), *(piece.column(k).take(pa.array(row)) for k in (0, 1)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "content", "id", "key", "start", "end"][: len(columns)])

    source = texts.select("id", "key", "text")
    anchors = source.mapInArrow(lambda b: found(b, True), "anchor long").groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    anchors = if_small(written(anchors, "repeated-anchors"), BROADCAST_ROWS)
    places = source.mapInArrow(lambda b: found(b, False), "anchor long, content long, id long, key long, start int, end int")
    places = written(places.join(anchors, "anchor", "left_semi"), "regions")

    kinds = written(places.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(F.struct("key", "id", "start", "end")).alias("one")), "region-kinds")
    # a kind with very many places is joined where its places are read, so that they do not meet in one task
    by_kind = ["anchor", "content"]
    copied = if_small(kinds.where(F.col("n") > HOT_PLACES).select(by_kind), BROADCAST_ROWS)
    twice = kinds.where((F.col("n") > 1) & (F.col("n") <= HOT_PLACES)).select(by_kind)
    spans = places.join(copied, by_kind, "left_semi").unionAll(places.join(copied, by_kind, "left_anti").join(twice, by_kind, "left_semi"))
    spans = spans.select("id", "key", "start", "end")

    sizes = written(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "kinds-of-anchors")
    several = if_small(sizes.where(F.col("kinds") <= HOT_KINDS).select("anchor"), BROADCAST_ROWS)
    hot = sizes.where(F.col("kinds") > HOT_KINDS).select("anchor")
    if not hot.isEmpty():
        hot = if_small(hot, BROADCAST_ROWS)
        crowded = _bytes_of(source, kinds.join(hot, "anchor", "left_semi").select("anchor", "one.*"))
        parts = written(crowded.mapInArrow(lambda b: _split(b, length, anchor), "id long, key long, anchor long, content long, start int, end int, bytes binary"), "parts-of-regions")
        of_part = written(parts.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(F.struct("key", "id", "start", "bytes")).alias("one")), "part-kinds")
        twice = if_small(of_part.where("n > 1").select("anchor", "content"), BROADCAST_ROWS)
        spans = spans.unionAll(parts.join(twice, ["anchor", "content"], "left_semi").select("id", "key", "start", "end"))
        open_ = of_part.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor")
        split = of_part.join(open_, "anchor", "left_semi").select("one.id", "one.key", "anchor", "one.start", "one.bytes")
        kinds = kinds.join(hot, "anchor", "left_anti")
    else:
        split = None
    whole = _bytes_of(source, kinds.join(several, "anchor", "left_semi").select("anchor", "one.*"))
    to_sort = whole if split is None else whole.unionAll(split)
    ordered = to_sort.repartition("anchor").sortWithinPartitions("anchor")

    def sort_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for i, k, a, s, raw in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if a != last and size >= BLOCK_BYTES:
                    yield _sorted_spans(rows, length)
                    rows, size = [], 0
                rows.append((i, k, s, raw))
                size += len(raw)
                last = a
        if rows:
            yield _sorted_spans(rows, length)

    return spans.unionAll(ordered.mapInArrow(sort_blocks, "id long, key long, start long, end long"))


_RESULT = "n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in B.bind_columns(batch, 1):
            out = []
            for text, spans in zip(piece.column(1).to_pylist(), piece.column(2).to_pylist(), strict=True):
                raw = (text or "").encode()
                merged: list[list[int]] = []
                for s in sorted((x["start"], x["end"]) for x in spans or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                edges = [0, *(e for m in merged for e in m), len(raw)]
                out.append((len(raw), sum(b - a for a, b in merged), [{"start": a, "end": b} for a, b in merged], b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))))
            n, removed, spans, kept = zip(*out, strict=True)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept) for every row of docs: the removed spans and the bytes that stay."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = picked(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("key", F.xxhash64("text"))
    spans = repeated_spans(texts, length, anchor).groupBy("id", "key").agg(F.collect_set(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))).alias("spans"))
    spans = written(spans.withColumnsRenamed({"id": "h_id", "key": "h_key"}), "removal-spans")
    same = F.col("id").eqNullSafe(F.col("h_id")) & (F.col("key") == F.col("h_key"))
    ids = if_small(spans.select("h_id", "h_key"), BROADCAST_ROWS)
    hit = texts.join(ids, same, "left_semi").join(spans, same).select("id", "text", "spans")
    raw = F.encode("text", "utf-8")
    clean = texts.join(ids, same, "left_anti").select(
        "id", F.length(raw).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"), raw.alias("kept")
    )
    return hit.mapInArrow(_cut, f"id long, {_RESULT}").unionByName(clean).withColumnRenamed("id", id_col)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
