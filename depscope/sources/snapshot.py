"""Keyed changes of a table as a new snapshot: upserts, replacement of partitions, pruning, cascades.

No table format with MERGE is assumed. Each function returns the rows of the next snapshot; `publish` writes them beside
the old ones, so that readers of the old snapshot are not disturbed and a lost job leaves nothing half-written.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _matched(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join by null-safe keys, with old and new rows as structs."""
    o = old.select(*[F.col(k).alias(f"__o_{k}") for k in keys], F.struct(*old.columns).alias("old"))
    n = new.select(*[F.col(k).alias(f"__n_{k}") for k in keys], F.struct(*[c for c in old.columns if c in new.columns]).alias("new"))
    return o.join(n, reduce(and_, [F.col(f"__o_{k}").eqNullSafe(F.col(f"__n_{k}")) for k in keys]), "full_outer")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = (), coalesce: list[str] = ()) -> DataFrame:
    """New rows replace old ones of their key. Columns in keep stay as they were; in coalesce a new null keeps the old value."""
    both = _matched(old, new, keys)
    here = F.col("new").isNotNull()
    out = []
    for c in old.columns:
        if c not in new.columns:
            value = F.col(f"old.{c}")
        elif c in keep:
            value = F.when(F.col("old").isNotNull(), F.col(f"old.{c}")).otherwise(F.col(f"new.{c}"))
        elif c in coalesce:
            value = F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}"))
        else:
            value = F.when(here, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))
        out.append(value.alias(c))
    return both.select(*out)


def changed(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """New rows whose key is new, or whose values differ from the old ones; nulls compare as values."""
    both = _matched(old, new, keys).where("new IS NOT NULL")
    differs = reduce(or_, [~F.col(f"old.{v}").eqNullSafe(F.col(f"new.{v}")) for v in values])
    return both.where(F.col("old").isNull() | differs).select("new.*")


def replace(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All old rows of each key that new has give way to the new rows."""
    fresh = new.select(*[F.col(k).alias(f"__n_{k}") for k in keys]).distinct()
    kept = old.join(fresh, reduce(and_, [F.col(k).eqNullSafe(F.col(f"__n_{k}")) for k in keys]), "left_anti")
    return kept.unionByName(new.select(*old.columns))


def prune(old: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows that were seen again."""
    return old.join(seen.select(*keys).distinct(), keys, "left_semi")


def delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows without those of the keys in gone; applied to each child table for a cascade."""
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def newest_only(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Of rows with equal keys, nulls included, the one with the greatest `by`."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), by).alias("row")).select("row.*")


def enqueue(jobs: DataFrame, asked: DataFrame) -> DataFrame:
    """Asked-for jobs (package_id, scope, ...) that no pending or running job stands for already, one for each key."""
    active = jobs.where(F.col("status").isin("pending", "running")).select("package_id", "scope").distinct()
    return asked.dropDuplicates(["package_id", "scope"]).join(active, ["package_id", "scope"], "left_anti")


def publish(df: DataFrame, root: str, version: int) -> str:
    """Write a snapshot in a folder of its own and return its path."""
    path = f"{root.rstrip('/')}/v{version:012d}"
    df.write.mode("errorifexists").parquet(path)
    return path


def current(spark: SparkSession, root: str) -> DataFrame:
    """The newest snapshot that was written to its end."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [s.getPath().toString() for s in fs.listStatus(fs_path) if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    if not done:
        raise FileNotFoundError(f"no snapshot under {root}")
    return spark.read.parquet(max(done))


def _files(spark: SparkSession, path: str):
    """(file system, function from a text to its path class) for a folder in any store."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def complete(spark: SparkSession, root: str) -> list[str]:
    """The folders of snapshots under root that were written to their end, oldest first."""
    fs, make = _files(spark, root)
    if not fs.exists(make(root)):
        return []
    return sorted(p for s in fs.listStatus(make(root)) if fs.exists(make(f"{(p := s.getPath().toString())}/_SUCCESS")))


def publish_once(df: DataFrame, root: str, stream: str, batch: int) -> str | None:
    """Publish a batch of a stream as the next snapshot, whatever the snapshots before it came from; None if this has happened.

    The snapshot is marked with the stream and the batch. One that was lost half-way is written over. There is one writer.
    """
    spark = df.sparkSession
    fs, make = _files(spark, root)
    done = complete(spark, root)
    mark = f"_batch-{stream}-{batch}"
    if any(fs.exists(make(f"{p}/{mark}")) for p in done):
        return None
    number = int(done[-1].rpartition("/v")[2]) + 1 if done else 0
    path = f"{root.rstrip('/')}/v{number:012d}"
    df.write.mode("overwrite").parquet(path)
    fs.create(make(f"{path}/{mark}")).close()
    return path


def publish_together(tables: dict[str, DataFrame], root: str, version: int) -> str:
    """Write tables as one snapshot. A mark is set when all are there; without it no reader takes the snapshot."""
    path = f"{root.rstrip('/')}/v{version:012d}"
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    fs, make = _files(spark, path)
    fs.create(make(f"{path}/_COMPLETE")).close()
    return path


def current_together(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables of the newest snapshot whose mark is set."""
    fs, make = _files(spark, root)
    found = [s.getPath().toString() for s in fs.listStatus(make(root)) if fs.exists(make(f"{s.getPath().toString()}/_COMPLETE"))] if fs.exists(make(root)) else []
    if not found:
        raise FileNotFoundError(f"no snapshot under {root}")
    return {n: spark.read.parquet(f"{max(found)}/{n}") for n in names}
