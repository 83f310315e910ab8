"""Source search by text or regular expression over a trigram index.

Files are stored in shards, a folder each, and beside them a table (gram, shard, ids) of the trigrams of their
lower-cased texts, sorted by trigram within each task, so that a query reads the pages of its own. Trigrams that the
expression can't do without give candidate files; only the shards that hold candidates are read, and only candidates
are matched, line by line. An expression that needs no trigram is matched against all files. Nothing is shuffled to
build the index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grams as G
from ..functions import text as X
from .lookup import top_by
from .stored import if_small, pieces, stored, text_lengths

SHARD_BYTES = 8 << 20
#: Text in a piece that a worker holds as an array of characters.
PIECE_BYTES = 4 << 20
#: Candidates that are broadcast.
BROADCAST_FILES = 200_000
#: Shards that a plan names one by one.
LISTED_SHARDS = 1000


@dataclass
class Index:
    """files: (shard, id, path, text), in folders by shard. grams: (gram, shard, ids)."""

    files: DataFrame
    grams: DataFrame


def build(files: DataFrame, id_col: str, path_col: str, text_col: str, shard_bytes: int = SHARD_BYTES) -> Index:
    """Store and index files; those whose text is null are left out. Numbers need not be unique, null ones stay."""
    source = files.select(F.col(id_col).cast("long").alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("text")).where("text IS NOT NULL")

    def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for piece in pieces(batch, text_lengths(batch.column(2)), min(shard_bytes, PIECE_BYTES)):
                if held >= shard_bytes:
                    shard, held = shard + 1, 0
                held += int(text_lengths(piece.column(2)).sum())
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(np.full(piece.num_rows, shard))], names=["id", "path", "text", "shard"])

    kept = stored(source.mapInArrow(sharded, "id long, path string, text string, shard long"), "source-files", by="shard")

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text_lengths(batch.column(2)), PIECE_BYTES):
                shards = piece.column(0).to_numpy()
                for first, last in zip(cuts := np.flatnonzero(np.diff(shards, prepend=shards[0] - 1)), [*cuts[1:], len(shards)], strict=True):
                    yield _rows(piece.slice(first, last - first), int(shards[first]))

    made = kept.select("shard", "id", F.lower("text").alias("text")).mapInArrow(indexed, "gram long, shard long, ids array<long>")
    return Index(kept, stored(made.sortWithinPartitions("gram", "shard"), "source-grams"))


def _rows(piece: pa.RecordBatch, shard: int) -> pa.RecordBatch:
    """A row for each trigram of some files of a shard."""
    texts = piece.column(2).to_pylist()
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    size = np.array([len(t) for t in texts])
    row = np.repeat(np.arange(len(size)), size)
    gram = codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]
    whole = np.flatnonzero(row[:-2] == row[2:]) if len(row) > 2 else np.empty(0, np.int64)
    gram, row = gram[whole], row[whole]
    order = np.argsort(gram, kind="stable")  # files stay ascending within a trigram
    gram, row = gram[order], row[order]
    other = np.diff(gram, prepend=-1) != 0
    once = np.flatnonzero(other | (np.diff(row, prepend=-1) != 0))
    first = np.flatnonzero(other[once])
    ids = piece.column(1).take(pa.array(row[once]))
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(once)), pa.int32()), ids)
    return pa.RecordBatch.from_arrays([pa.array(gram[once[first]]), pa.array(np.full(len(first), shard)), lists], names=["gram", "shard", "ids"])


def candidates(index: Index, needs: G.Needs) -> DataFrame | None:
    """(shard, id) of the files that hold what is needed; None if nothing is."""
    if not needs:
        return None
    wanted = sorted({G.code(g) for member in needs for some in member for g in some})
    held = index.grams.where(F.col("gram").isin(*wanted)).select("shard", F.explode("ids").alias("id"), "gram").groupBy("shard", "id").agg(F.collect_set("gram").alias("held"))
    has = lambda some: F.size(F.array_except(F.array(*[F.lit(G.code(g)) for g in sorted(some)]), "held")) == 0
    return held.where(reduce(and_, [reduce(or_, [has(some) for some in member]) for member in needs])).select("shard", "id")


def matching_lines(index: Index, pattern: str, expression: bool = False, path_glob: str | None = None) -> DataFrame:
    """(id, path, line_no, line) of the lines that a text, or an expression, finds in any case; * and ? of path_glob stand for any run and any character."""
    found = candidates(index, G.of_expression(pattern) if expression else G.of_text(pattern))
    files = index.files
    if path_glob is not None:
        files = files.where(F.col("path").like(X.glob_to_like(path_glob)))
    if found is not None:
        found = stored(found, "candidates")
        shards = found.select("shard").distinct().limit(LISTED_SHARDS + 1).collect()
        if len(shards) <= LISTED_SHARDS:  # then no other folder is opened
            files = files.where(F.col("shard").isin(*[r["shard"] for r in shards]) if shards else F.lit(False))
        found = if_small(found, BROADCAST_FILES).select(F.col("shard").alias("in_shard"), F.col("id").alias("of"))
        files = files.join(found, (F.col("shard") == F.col("in_shard")) & F.col("id").eqNullSafe(F.col("of")), "left_semi")
    lines = files.select("id", "path", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.where(_hit(pattern, expression)).select("id", "path", (F.col("line_no") + 1).cast("long").alias("line_no"), "line")


def _hit(pattern: str, expression: bool) -> Column:
    return F.rlike("line", F.lit(f"(?i){pattern}")) if expression else X.contains(F.col("line"), pattern)


def first_matches(lines: DataFrame, width: int = 220) -> DataFrame:
    """The first matching line of each file, and how many match."""
    shown = F.substring(F.trim("line"), 1, width).alias("snippet")
    return lines.groupBy("id", "path").agg(F.min_by(F.struct("line_no", shown), "line_no").alias("m"), F.count("*").alias("matches")).select("id", "path", "m.line_no", "m.snippet", "matches")


def capped(lines: DataFrame, per_file: int, total: int, width: int = 300) -> DataFrame:
    """At most per_file matches of each file and total of all, by path and line."""
    some = top_by(lines, ["id", "path"], per_file, F.col("line_no"))
    return some.orderBy("path", "id", "line_no").limit(total).select("id", "path", "line_no", F.substring("line", 1, width).alias("snippet"))
