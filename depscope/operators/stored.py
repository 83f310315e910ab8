"""Tables that operators keep between steps, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where it is unset and Spark is local, as in tests."""
    conf = spark.sparkContext.getConf()
    folder, master = conf.get("spark.checkpoint.dir"), conf.get("spark.master", "")
    if folder:
        return folder.rstrip("/")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(f"file://{tempfile.mkdtemp(prefix='depscope-')}")
    return _own[0]


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/depscope/{name}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch that a Python worker gets while a table is written.
BATCH_BYTES = 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While this holds, a worker gets few MB of rows at once, however long they are; the session has its own limit again afterwards."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, name: str, by: str | None = None, page_rows: int | None = None) -> DataFrame:
    """df written as Parquet and read again: what follows recomputes nothing before it. by: a column whose values are folders; page_rows: the most rows of a page."""
    path = fresh(df.sparkSession, name)
    writer = df.write.partitionBy(by) if by else df.write
    writer = writer.option("parquet.page.row.count.limit", page_rows) if page_rows else writer
    with small_batches(df.sparkSession):
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def if_small(df: DataFrame, rows: int) -> DataFrame:
    """df, which is stored and narrow, marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= rows else df


def pieces(batch: pa.RecordBatch, sizes: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of about so many bytes, of one row at least."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if batch.num_rows:
        yield batch.slice(start)


def text_lengths(column: pa.Array) -> np.ndarray:
    return pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
