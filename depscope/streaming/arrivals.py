"""Landed files as streams: every new file once, and changed snapshots in the order of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import snapshot


def archives(spark: SparkSession, path: str, glob: str = "*.crate") -> DataFrame:
    """(package, version, path, arrived) of each archive as it lands; names split at the last hyphen before a version."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).load(path)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[A-Za-z]+$", "")
    pattern = r"^([^.+]+)-(\d+\.\d+\.\d+(?:[-+][0-9A-Za-z.+-]+)?)$"
    return files.select(F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")).alias("package"), F.nullif(F.regexp_extract(name, pattern, 2), F.lit("")).alias("version"), "path", F.col("modificationTime").alias("arrived"))


def query_id(spark: SparkSession) -> str:
    """What tells the running stream from others: it stays with the checkpoint."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"


def upserts(stream: DataFrame, root: str, keys: list[str], order: str, checkpoint: str):
    """Keep a snapshot table under root up to date: in each batch the last row of a key wins, then a new snapshot is published.

    A batch that comes again, after a restart, is published once; another stream, or a new checkpoint, goes on above the
    snapshots that are there.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = snapshot.newest_only(batch, keys, order)
        old = snapshot.current(spark, root) if snapshot.complete(spark, root) else newest.limit(0)
        snapshot.publish_once(snapshot.upsert(old, newest, keys), root, query_id(spark), batch_id)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
