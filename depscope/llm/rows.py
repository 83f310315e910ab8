"""Row-wise operators over Arrow batches that keep the other columns of their input, whatever these are called."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytesops import bind_columns

#: From a few MB of texts to the new columns.
Make = Callable[[pa.Array], list[pa.Array]]


def place_of(df: DataFrame, name: str) -> int:
    """The place of a column: the one of exactly this name, else, as Spark ignores case, the first of this name in any case."""
    if name in df.columns:
        return df.columns.index(name)
    lowered = [c.lower() for c in df.columns]
    if name.lower() not in lowered:
        raise ValueError(f"no column {name!r} among {df.columns}")
    return lowered.index(name.lower())


def numbered(df: DataFrame) -> DataFrame:
    """df with columns c0, c1, ...: work columns of other names clash with none of them."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def picked(df: DataFrame, *names: str) -> DataFrame:
    """The columns of these names, as place_of() finds them, under exactly these names."""
    work = numbered(df)
    return work.select(*[F.col(f"c{place_of(df, n)}").alias(n) for n in names])


def _with_values(work: DataFrame, places: list[int], text: int, fields: list[T.StructField], fn: Make) -> DataFrame:
    """Columns c<place> and then v_<field>."""
    source = work.select(*[F.col(f"c{i}") for i in places], F.col(f"c{text}").cast("string").alias("text"))
    n = len(places)
    schema = T.StructType([*source.schema.fields[:n], *[T.StructField(f"v_{f.name}", f.dataType, f.nullable) for f in fields]])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in bind_columns(batch, n):
                yield pa.RecordBatch.from_arrays([*piece.columns[:n], *fn(piece.column(n))], names=names)

    return source.mapInArrow(run, schema)


def with_arrow_columns(df: DataFrame, text: str, fields: list[T.StructField], fn: Make, keep: list[str] | None = None) -> DataFrame:
    """df with the columns `fields`, which fn makes from the text column of a few MB of rows.

    keep: columns to carry along (default: all). A column of the input with the name of a new one, in any case, is
    replaced.
    """
    new = {f.name.lower() for f in fields}
    places = [i for i in (range(len(df.columns)) if keep is None else [place_of(df, c) for c in keep]) if df.columns[i].lower() not in new]
    made = _with_values(numbered(df), places, place_of(df, text), fields, fn)
    return made.toDF(*[df.columns[i] for i in places], *[f.name for f in fields])


def with_numbered_columns(df: DataFrame, text: str, fields: list[T.StructField], fn: Make) -> tuple[DataFrame, int]:
    """(numbered(df) with the columns `fields` as v_<field>, place of the text)."""
    at = place_of(df, text)
    return _with_values(numbered(df), list(range(len(df.columns))), at, fields, fn), at


def with_new_text(df: DataFrame, text: str, fields: list[T.StructField], fn: Make, cleaned: str, kept: str | None = None) -> DataFrame:
    """df with its own columns, the text being the new column `cleaned`; n_chars, if df has it, follows.

    kept: the new column that says which rows stay (default: all).
    """
    made, at = with_numbered_columns(df, text, fields, fn)
    if kept:
        made = made.where(F.col(f"v_{kept}"))
    return made.select(*renewed(df, at, F.col(f"v_{cleaned}"))).toDF(*df.columns)


def renewed(df: DataFrame, text: int, new: Column) -> list[Column]:
    """The columns of numbered(df), with a new text and its length."""
    return [new if i == text else F.length(new).cast("long") if c.lower() == "n_chars" else F.col(f"c{i}") for i, c in enumerate(df.columns)]
