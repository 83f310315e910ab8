"""N-gram Jaccard join: rare-first prefixes, length, positional and suffix filters, one verification per pair.

Plan, for sets of distinct `size`-word shingles and a threshold num/den:

1. Heavy shingles. Each task sorts the shingles of some thousand documents at a time and reports those that it saw
   LOCAL_COUNT times; the HEAVY_LIMIT with the largest sums are the heavy ones, a table of fixed size. The global
   order is: shingles that are not heavy by hash, then heavy ones by count. Any fixed order gives right results; this
   one keeps frequent shingles out of prefixes.
2. One row per document: set size, 128-bit set signature, the prefix in that order (its length follows from the
   threshold) and a parity sketch of two bits or more per shingle. Equal sets collapse to the least id.
3. Prefix shingles that two sets share make postings. Each set is verified against one pivot of its postings; what
   these links join is one component. Then, within each posting, every pair of *different* components that passes the
   length, positional and suffix filters is verified, once. The suffix filter bounds how far the rests of two sets
   differ: every shingle of one set only flips one bit of its sketch, so sketches differ in no more bits than sets
   in shingles. Folded to 512 bits it is part of the join's condition; pairs that pass are held against whole
   sketches, and only the texts of those that pass again travel to be verified. A pair inside one component can change nothing, so no
   link that counts is lost, and a large group of near copies costs its size, not its square.
4. Components of all links, by rounds of stars in the shared folder.

Defined cases: null or wordless text has no shingles and links with nothing; a null id has no component; repeated
rows of one id are one node and all returned; shorter texts have their whole sequence as one shingle; of
linked rows with the same least id any one stays; a text of any length is one row; columns of any name are carried along; an
empty table gives an empty result.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B
from .components import components
from .rows import numbered, picked, place_of
from .scratch import if_small, release, small_batches, written

HEAVY_LIMIT = 1 << 16
LOCAL_COUNT = 4
CHUNK = 1 << 21
SKETCH = [f"s{k}" for k in range(8)]
#: A set's size and 128 bits of hash; rows that agree on them have equal sets.
SIGNATURE = ["n", "sig_a", "sig_b"]
#: Narrow tables of at most so many rows, counted first, may be broadcast; larger ones are joined by shuffles.
BROADCAST_ROWS = 1_000_000


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the sorted distinct shingle hashes of each text."""
    data, off = B.text_bytes(texts)
    data = B.LOWER[data]
    starts, ends, first = B.word_spans(data, off)
    h, first = B.shingle_hashes(B.span_hash(B.prefix_hash(data), starts, ends), first, size)
    for a, b in zip(first[:-1], first[1:], strict=True):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = h[1:] != h[:-1]
    keep[first[:-1][np.diff(first) > 0]] = True
    return h[keep], np.concatenate([[0], np.cumsum(keep)])[first]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return picked(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def heavy_shingles(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, their ranks from 1): at most HEAVY_LIMIT shingles that most documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def counted() -> pa.RecordBatch:
            h = np.sort(np.concatenate(held))
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            count = np.diff(np.append(at, len(h)))
            some = count >= LOCAL_COUNT
            return pa.RecordBatch.from_arrays([pa.array(h[at[some]].view(np.int64)), pa.array(count[some])], names=["h", "n"])

        for batch in batches:
            for piece in B.bind_columns(batch, 0):
                h, _ = shingle_sets(piece.column(0), size)
                held.append(h)
                n += len(h)
                if n >= CHUNK:
                    yield counted()
                    held, n = [], 0
        if n:
            yield counted()

    counts = texts.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    with small_batches(texts.sparkSession):
        rows = counts.orderBy(F.desc("n"), "h").limit(HEAVY_LIMIT).toArrow()
    h = rows["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], (len(h) - np.arange(len(h)))[order].astype(np.int64)


def _sketch(h: np.ndarray) -> np.ndarray:
    """Parity of the hashes that fall on each bit, 64 bits a word; the number of bits is a power of two from 512 to 65536."""
    bits = 1 << min(max((2 * len(h)).bit_length(), 9), 16)
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch that the same set has with fewer bits."""
    while len(sketch) > words:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


_SET = "id long, n long, sig_a long, sig_b long, prefix array<long>, sketch binary, " + ", ".join(f"{s} long" for s in SKETCH)


def set_rows(texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """One row per document: its set's size, signature, prefix and parity sketch."""
    heavy = texts.sparkSession.sparkContext.broadcast(heavy_shingles(texts, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy_h, rank = heavy.value
        for batch in batches:
            for piece in B.bind_columns(batch, 1):
                h, first = shingle_sets(piece.column(1), size)
                n = np.diff(first)
                row = B.row_of(first)
                sums = np.zeros((2, len(n)), np.uint64)
                full = np.flatnonzero(n)
                if len(full):
                    sums[0, full] = np.add.reduceat(B.mix(h), first[full])
                    sums[1, full] = np.add.reduceat(B.mix(h * np.uint64(0x9FB21C651E98DF25) + np.uint64(1)), first[full])
                weight = np.zeros(len(h), np.int64)
                if len(heavy_h) and len(h):
                    at = np.minimum(np.searchsorted(heavy_h, h), len(heavy_h) - 1)
                    hit = heavy_h[at] == h
                    weight[hit] = rank[at[hit]]
                length = np.where(n > 0, n - -(-num * n // den) + 1, 0)
                light = np.bincount(row[weight == 0], minlength=len(n))
                prefix = []
                for i in full:
                    a, b, p = first[i], first[i + 1], length[i]
                    w, x = weight[a:b], h[a:b]
                    if light[i] >= p:
                        prefix.append(x[w == 0][:p] if light[i] < b - a else x[:p])
                    else:
                        prefix.append(x[np.argsort(w, kind="stable")[:p]])
                flat = np.concatenate(prefix) if prefix else np.empty(0, np.uint64)
                sketches = [_sketch(h[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                short = np.array([_folded(x, len(SKETCH)) for x in sketches]).reshape(-1, len(SKETCH)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0), pa.array(n), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(flat.view(np.int64))),
                        pa.array([x.tobytes() for x in sketches], pa.binary()), *(pa.array(short[:, k].copy()) for k in range(len(SKETCH))),
                    ],
                    names=["id", "n", "sig_a", "sig_b", "prefix", "sketch", *SKETCH],
                )

    return texts.select("id", "text").mapInArrow(run, _SET)


def _may_link(n1: Column, p1: Column, n2: Column, p2: Column, num: int, den: int) -> Column:
    """Length and positional filters for two sets that share the shingle at places p1 and p2 of their order.

    Linked sets differ in at most (1 - t) / (1 + t) of their sizes' sum, and what stands before the first shingle
    that they share is all different; so for linked sets one shared shingle at least passes.
    """
    most = F.least(p1, p2) + 1 + F.least(n1 - 1 - p1, n2 - 1 - p2)
    first = (den + num) * (p1 + p2) <= (den - num) * (n1 + n2)
    return (den * n1 >= num * n2) & (den * n2 >= num * n1) & ((den + num) * most >= num * (n1 + n2)) & first


def _in_reach(x: str, y: str, num: int, den: int) -> Column:
    """Suffix filter for rows with columns n and SKETCH of two sets under these prefixes: may the sets differ so little?"""
    apart = reduce(operator.add, (F.bit_count(F.col(x + s).bitwiseXOR(F.col(y + s))) for s in SKETCH))
    return (den + num) * apart <= (den - num) * (F.col(f"{x}n") + F.col(f"{y}n"))


def _after_sketches(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """Suffix filter with whole sketches: pairs (a, b) that may still differ little enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            apart = []
            for x, y in zip(batch.column(4), batch.column(5), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                words = min(len(x), len(y))
                apart.append(int(np.bitwise_count(_folded(x, words) ^ _folded(y, words)).sum()))
            yield batch.filter(pa.array((den + num) * np.array(apart, np.int64) <= (den - num) * n)).select([0, 1])

    side = lambda k: reps.select(F.col("rep").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"sketch_{k}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
    return joined.mapInArrow(run, "a long, b long").distinct()


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def _verified(pairs: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets meet the threshold. Texts take less room than their sets, so they travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok: list[bool] = []
            for piece in B.bind_columns(batch, 2):
                x, x_first = shingle_sets(piece.column(2), size)
                y, y_first = shingle_sets(piece.column(3), size)
                for i in range(piece.num_rows):
                    both = np.concatenate([x[x_first[i] : x_first[i + 1]], y[y_first[i] : y_first[i + 1]]])
                    both.sort(kind="stable")
                    common = np.count_nonzero(both[1:] == both[:-1])
                    ok.append(den * common >= num * (len(both) - common))
            yield batch.filter(pa.array(ok, pa.bool_())).select([0, 1])

    ids = written(pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct(), "pair-ids")
    found = texts.join(if_small(ids, BROADCAST_ROWS), "id", "left_semi").select("id", "text")
    first = pairs.join(found.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    both = first.join(found.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def _classes(texts: DataFrame, size: int, num: int, den: int, unique: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, sets) of texts (id, text): rows have id and the signature of their set, sets a signature, rep, the least id
    of the rows that have the set, and found, the least id reachable from it. unique: no id stands twice."""
    signature = SIGNATURE
    full = written(set_rows(texts, size, num, den), "shingle-sets")
    real = full.where("n > 0 AND id IS NOT NULL")
    whole = written(real.groupBy(*signature).agg(F.min("id").alias("rep"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"), *[F.first(s).alias(s) for s in SKETCH]), "distinct-sets")
    rows = written(full.select("id", *signature), "signatures")
    real = rows.where("n > 0 AND id IS NOT NULL")
    release(full)

    # postings of two sets at least, each with the pivot of its shingle: the set that has it first. Pivots are one row
    # a shingle, from partial minima, so the join splits a posting that holds a large part of all sets
    entries = whole.select("rep", "n", F.posexplode("prefix").alias("p", "h"))
    pivots = entries.groupBy("h").agg(F.count("*").alias("df"), F.min(F.struct("p", "rep", "n")).alias("pivot")).where("df > 1")
    pivots = written(pivots.select("h", *[F.col(f"pivot.{c}").alias(f"pivot_{c}") for c in ("rep", "n", "p")]), "pivots")
    entries = written(entries.join(pivots, "h"), "postings")
    release(pivots)
    reps = written(whole.select("rep", *signature, "sketch", *SKETCH), "representatives")
    release(whole)

    tried = entries.where((F.col("rep") != F.col("pivot_rep")) & _may_link(*(F.col(c) for c in ("n", "p", "pivot_n", "pivot_p")), num, den))
    best = tried.groupBy("rep", "pivot_rep").agg(F.count("*").alias("k")).groupBy("rep").agg(F.max(F.struct("k", "pivot_rep")).alias("best"))
    best = best.select(F.least("rep", "best.pivot_rep").alias("a"), F.greatest("rep", "best.pivot_rep").alias("b")).distinct()
    sketches = reps.select("rep", "n", *SKETCH)
    stars = written(_after_sketches(best, reps, num, den), "star-pairs")
    links = written(_verified(stars, texts, size, num, den), "star-links")

    # shingles whose postings are not all in one component, and their pairs across components
    joined = if_small(written(components(links), "components"), BROADCAST_ROWS)
    of = lambda rows, c: rows.join(joined.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in")), c, "left").withColumn(f"{c}_in", F.coalesce(f"{c}_in", c))
    apart = of(of(entries, "rep"), "pivot_rep").where("rep_in <> pivot_rep_in").select("h").distinct()
    apart = if_small(written(apart, "mixed-shingles"), BROADCAST_ROWS)
    placed = written(of(entries.join(apart, "h", "left_semi").select("h", "rep", "n", "p"), "rep").withColumnRenamed("rep_in", "component"), "mixed-postings")
    release(entries)
    top = placed.groupBy("h", "component").agg(F.count("*").alias("k")).groupBy("h").agg(F.max(F.struct("k", "component")).alias("top")).select("h", F.col("top.component").alias("top"))
    in_mixed = placed.join(top, "h").join(sketches, ["rep", "n"])
    left, right = _prefixed(in_mixed.where("component <> top"), "l_"), _prefixed(in_mixed, "r_")
    differ = (F.col("l_component") != F.col("r_component")) & ((F.col("r_component") == F.col("r_top")) | (F.col("l_rep") < F.col("r_rep")))
    passed = _may_link(*(F.col(c) for c in ("l_n", "l_p", "r_n", "r_p")), num, den) & _in_reach("l_", "r_", num, den)
    cross = left.join(right, (F.col("l_h") == F.col("r_h")) & differ & passed).select(F.least("l_rep", "r_rep").alias("a"), F.greatest("l_rep", "r_rep").alias("b"))
    candidates = written(cross.distinct().join(stars, ["a", "b"], "left_anti"), "cross-candidates")
    release(placed)
    release(stars)
    cross = written(_after_sketches(candidates, reps, num, den), "cross-pairs")
    release(candidates)
    found = links.unionAll(_verified(cross, texts, size, num, den))
    if not unique:
        found = found.unionAll(_same_id(real, reps))
    merged = components(found)
    release(cross)
    release(links)
    named = reps.select(*signature, "rep").join(merged.withColumnRenamed("node", "rep"), "rep", "left").select(*signature, "rep", F.coalesce("component", "rep").alias("found"))
    return rows.select("id", *signature), named


def _same_id(real: DataFrame, reps: DataFrame) -> DataFrame:
    """Links between the sets of rows that share an id."""
    signature = SIGNATURE
    several = real.groupBy("id").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in signature for f in (F.min, F.max)]).where(" OR ".join(f"min_{c} <> max_{c}" for c in signature)).select("id")
    return real.join(several, "id", "left_semi").join(reps.select(*signature, "rep"), signature).select(F.col("id").alias("a"), F.col("rep").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(id, n_shingles, component_id) for every row of docs: the least id reachable by links of Jaccard num/den or more.

    Rows that share an id are one document, so their links are joined. No other column of docs is returned.
    """
    rows, sets = _classes(_texts(docs, id_col, text_col), size, num, den)
    own = rows.join(sets, SIGNATURE, "left")
    return own.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("found", "id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each group of linked rows: the one of least id, with its own columns.

    Rows are told apart by their place, not by their id: rows of one id with unlinked texts all stay. So do rows of a
    null id, and those without a shingle, which link with nothing. Of linked rows with one id the first by the hash of
    all columns stays.
    """
    work = numbered(docs)
    text = f"c{place_of(docs, text_col)}"
    own_id = F.col(f"c{place_of(docs, id_col)}").cast("long")
    plain = [c for c, f in zip(work.columns, work.schema.fields, strict=True) if not f.dataType.simpleString().startswith(("map", "variant"))]
    rank = F.struct(own_id.alias("id"), F.xxhash64(*plain).alias("tie"))
    # the number of a row is its node, so it must not change between readings
    numbers = written(work.withColumn("rank", rank).withColumn("node", F.monotonically_increasing_id()), "numbered-rows")
    rows, sets = _classes(numbers.where("rank.id IS NOT NULL").select(F.col("node").alias("id"), F.col(text).cast("string").alias("text")), size, num, den, unique=True)
    group = rows.where("n > 0").join(sets, SIGNATURE).select(F.col("id").alias("node"), "found")
    # one row of each group by partial minima; no join goes by the group, which may be large
    stays = group.join(numbers.select("node", "rank"), "node").groupBy("found").agg(F.min(F.struct("rank", "node")).alias("first")).select("first.node")
    gone = group.select("node").join(stays, "node", "left_anti")
    return numbers.join(gone, "node", "left_anti").select(*work.columns).toDF(*docs.columns)


OP3_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
    SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') AS g
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
reach AS (SELECT a AS doc_id, b AS other FROM link UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m.low, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id) m USING (doc_id)
"""


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, size=4, num=85, den=100)
