"""Names that appear for the first time, out of a stream of landed versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import snapshot
from .arrivals import query_id

SCHEMA = "package string, versions array<string>, arrived timestamp, prewarm boolean"


def arrivals_once(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """The stream (package, version, arrived) without what comes again within the delay; older state is dropped."""
    named = stream.where("package IS NOT NULL").withColumn("package", F.lower(F.trim("package"))).where("package <> ''")
    return named.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["package", "version"])


def unknown(batch: DataFrame, known: DataFrame, prewarm: tuple[str, ...] = ()) -> DataFrame:
    """(package, versions, arrived, prewarm) of packages of a batch that known (package) doesn't have, without regard to case.

    Packages in prewarm are marked, to be taken first.
    """
    there = known.select(F.lower(F.trim("package")).alias("package")).distinct()
    rows = batch.groupBy("package").agg(F.array_sort(F.collect_set("version")).alias("versions"), F.min("arrived").alias("arrived"))
    return rows.join(there, "package", "left_anti").withColumn("prewarm", F.col("package").isin(*[p.strip().lower() for p in prewarm]) if prewarm else F.lit(False))


def discovered(spark: SparkSession, root: str) -> DataFrame:
    """All names that have been discovered, each once."""
    done = snapshot.complete(spark, root)
    return spark.read.schema(SCHEMA).parquet(*done) if done else spark.createDataFrame([], SCHEMA)


def discoveries(stream: DataFrame, root: str, known: Callable[[SparkSession], DataFrame], checkpoint: str, delay: str = "1 day", prewarm: tuple[str, ...] = ()):
    """A stream that adds to root what is new in each batch: neither known(), read anew for each batch, nor discovered before.

    A batch is published once; batches without new names add an empty snapshot, so that a repeated one is still known.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = known(spark).select("package").unionByName(discovered(spark, root).select("package"))
        snapshot.publish_once(unknown(batch, before, prewarm), root, query_id(spark), batch_id)

    return arrivals_once(stream, delay).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
