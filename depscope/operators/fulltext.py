"""Full-text search: an inverted index with positions, web-search syntax, phrases, ranks.

The index is a table (stem, ids, positions): a row for each stem of each few MB of texts, with the documents that hold
it and its places in each. The rows of each piece are sorted by stem, and pages are short, so that a query reads those
of its own stems; nothing is shuffled or sorted beyond a piece, and no row grows with the table. Words keep their positions, stop words included, so phrases may
span these.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import english
from .stored import pieces, stored, text_lengths

#: Bytes of the texts whose words make rows together.
PIECE_BYTES = 4 << 20
_WORD = re.compile(r"[^\W_]+")
#: Rows of a page of the stored index: fewer than the stems of a piece, so that a page spans few stems.
PAGE_ROWS = 500
#: The sum of 1 / n^2, to which a stem's occurrences come closer.
_LIMIT = 1.64493406685


@dataclass(frozen=True)
class Config:
    """How words become stems; None for words that are left out."""

    stems: bool = True

    def stem(self, word: str) -> str | None:
        if not self.stems:
            return word
        return None if word in english.STOP_WORDS else english.stem(word)


ENGLISH, SIMPLE = Config(), Config(stems=False)


def postings(docs: DataFrame, id_col: str, text_col: str, config: Config = ENGLISH) -> DataFrame:
    """(stem, ids, positions) of the texts of docs, in rows as the index has them; positions begin with 1."""
    source = docs.select(F.col(id_col).alias("id"), F.lower(text_col).alias("text")).where("text IS NOT NULL")
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text_lengths(batch.column(1)), PIECE_BYTES):
                yield _rows(piece, config)

    return source.mapInArrow(run, f"stem string, ids array<{kind}>, positions array<array<int>>")


def _rows(piece: pa.RecordBatch, config: Config) -> pa.RecordBatch:
    number: dict[str, int] = {}
    of_word: dict[str, int] = {}
    stems, size = [], []
    for text in piece.column(1).to_pylist():
        found = _WORD.findall(text)
        size.append(len(found))
        for w in found:
            k = of_word.get(w)
            if k is None:
                s = config.stem(w)
                k = of_word[w] = -1 if s is None else number.setdefault(s, len(number))
            stems.append(k)
    stem, size = np.array(stems, np.int64), np.array(size, np.int64)
    row = np.repeat(np.arange(len(size)), size)
    position = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + 1
    names = pa.array(list(number), pa.string())
    place = np.empty(len(number) + 1, np.int64)  # of each stem in the order of their bytes, which Parquet compares
    by_name = sorted(range(len(number)), key=list(map(str.encode, number)).__getitem__)
    place[by_name], place[-1] = np.arange(len(number)), -1
    names, stem = names.take(pa.array(by_name, pa.int64())), place[stem]
    order = np.argsort(stem, kind="stable")  # documents and positions stay ascending within a stem
    order = order[np.searchsorted(stem[order], 0) :]
    stem, row = stem[order], row[order]
    other = np.diff(stem, prepend=-1) != 0
    first = np.flatnonzero(other | (np.diff(row, prepend=-1) != 0))
    begun = np.flatnonzero(other[first])
    places = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(position[order].astype(np.int32)))
    bounds = pa.array(np.append(begun, len(first)), pa.int32())
    ids = piece.column(0).take(pa.array(row[first]))
    return pa.RecordBatch.from_arrays([names.take(pa.array(stem[first[begun]])), pa.ListArray.from_arrays(bounds, ids), pa.ListArray.from_arrays(bounds, places)], names=["stem", "ids", "positions"])


@dataclass
class Index:
    """The index of some documents. ids: the number of each of them."""

    table: DataFrame
    ids: DataFrame
    config: Config

    def of(self, stems: list[str]) -> DataFrame:
        """(stem, id, positions) of these stems."""
        pairs = F.explode(F.arrays_zip("ids", "positions"))
        return self.table.where(F.col("stem").isin(*stems)).select("stem", pairs.alias("of")).select("stem", F.col("of.ids").alias("id"), "of.positions")


def build(docs: DataFrame, id_col: str, text_col: str, config: Config = ENGLISH) -> Index:
    """Index the texts of docs, whose numbers tell them apart; null texts have no words."""
    rows = postings(docs, id_col, text_col, config)
    return Index(stored(rows, "fulltext", page_rows=PAGE_ROWS), docs.select(F.col(id_col).alias("id")), config)


# queries


@dataclass(frozen=True)
class Literal:
    """Stems at distances from the first; a single stem is a phrase of one."""

    phrase: tuple[tuple[int, str], ...]
    negated: bool = False


def parse(text: str, config: Config = ENGLISH) -> list[list[Literal]]:
    """Clauses of which one must hold, each of literals that all must.

    "a b" is a phrase, -a or -"a b" must not occur, a word `or` parts clauses, all other words must occur; what holds
    several words without blanks is a phrase of them. Stop words are left out but keep their place in a phrase. A quote
    that isn't closed means nothing, and so does an `or` without clauses on both sides.
    """
    clauses: list[list[Literal]] = [[]]
    if text.count('"') % 2:
        text = " ".join(text.rsplit('"', 1))
    for minus, quoted, plain in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', text):
        if plain.lower() == "or" and not minus:
            clauses.append([])
            continue
        found = [(k, config.stem(w)) for k, w in enumerate(_WORD.findall((quoted or plain).lower()))]
        stems = [(k, s) for k, s in found if s is not None]
        if stems:
            clauses[-1].append(Literal(tuple((k - stems[0][0], s) for k, s in stems), minus == "-"))
    return [c for c in clauses if c]


def _holds(literal: Literal) -> Column:
    """Whether a document's map of stems to positions holds the literal."""
    at = lambda s: F.coalesce(F.try_element_at("held", F.lit(s)), F.array().cast("array<int>"))
    earlier = lambda places, k: F.transform(places, lambda x: x - k) if k else places
    places = [earlier(at(s), k) for k, s in literal.phrase]
    found = F.size(reduce(F.array_intersect, places)) > 0
    return ~found if literal.negated else found


def match(index: Index, query: str) -> DataFrame:
    """(id, rank) of the documents that a query finds; none for a query without stems.

    The rank is the mean over the query's stems of 0.1 * (1 + 1/4 + 1/9 + ...), a summand for each occurrence.
    """
    clauses = parse(query, index.config)
    wanted = sorted({s for c in clauses for x in c for _, s in x.phrase})
    if not wanted:
        return index.ids.where("false").select("id", F.lit(0.0).alias("rank"))
    ranked = sorted({s for c in clauses for x in c if not x.negated for _, s in x.phrase})
    rows = index.of(wanted).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("stem", "positions"))).alias("held"))
    if any(all(x.negated for x in c) for c in clauses):  # then documents without any of the stems are found too
        rows = index.ids.join(rows, "id", "left").withColumn("held", F.coalesce("held", F.create_map().cast("map<string,array<int>>")))
    found = rows.where(reduce(or_, [reduce(and_, [_holds(x) for x in c]) for c in clauses]))
    times = lambda s: F.coalesce(F.size(F.try_element_at("held", F.lit(s))), F.lit(0))
    summed = lambda n: F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda a, j: a + 1.0 / (j.cast("double") * j))).otherwise(0.0)
    rank = reduce(lambda a, b: a + b, [summed(times(s)) for s in ranked], F.lit(0.0)) * 0.1 / _LIMIT / max(len(ranked), 1)
    return found.select("id", rank.alias("rank"))
