"""Where the operators keep what they cut lineage with: the shared folder in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where it is unset and the master is local (tests)."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _made:
        _made.append(tempfile.mkdtemp(prefix="depscope-"))
    return f"file://{_made[0]}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/depscope/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, batch_rows: int = 512) -> DataFrame:
    """The rows of df, written as Parquet in the shared folder and read again: lost executors recompute nothing before this."""
    path = fresh_path(df.sparkSession, name)
    with small_batches(df.sparkSession, batch_rows):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def if_small(df: DataFrame, rows: int) -> DataFrame:
    """df, which is written and of narrow rows, marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= rows else df


def release(df: DataFrame) -> None:
    """Delete what written() made, once nothing reads it any more."""
    for f in {f.rpartition("/")[0] for f in df.inputFiles()}:
        drop(df.sparkSession, f)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, as the path may be in a store that only Spark reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """Texts may be long: while this holds, Arrow batches of few rows bound what a Python worker keeps.

    The session has its own limits again afterwards. Plans that an operator returns unrun go by those, and workers cut
    their batches into small pieces.
    """
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
    before = {k: spark.conf.get(k) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
