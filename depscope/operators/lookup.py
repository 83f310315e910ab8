"""Look-ups over packages, versions and dependency edges, for all packages at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_first() -> tuple[Column, Column]:
    """Newest first; ties of the publishing time are broken by id, so that the order is total."""
    return F.col("published_at").desc_nulls_last(), F.col("version_id").desc()


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in the order."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rank = 1").drop("__rank")


def top_by(df: DataFrame, keys: list[str], k: int, *order: Column, rank: str = "place") -> DataFrame:
    """The first k rows for each key, with their place."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col(rank) <= k)


def latest(versions: DataFrame) -> DataFrame:
    """The newest version of each package; yanked ones count."""
    return first_by(versions, ["package_id"], *newest_first())


def exact_version(versions: DataFrame, version: str) -> DataFrame:
    return versions.where(F.col("version") == version)


def download_totals(versions: DataFrame) -> DataFrame:
    return versions.groupBy("package_id").agg(F.coalesce(F.sum("downloads"), F.lit(0)).alias("total_downloads"), F.max("published_at").alias("last_published"), F.count("*").alias("n_versions"))


def history(versions: DataFrame, limit: int) -> DataFrame:
    return top_by(versions, ["package_id"], limit, *newest_first())


def dependencies(edges: DataFrame, versions: DataFrame, packages: DataFrame) -> DataFrame:
    """Edges of the given versions, with the names of their targets."""
    target = packages.select(F.col("package_id").alias("target_id"), F.col("name").alias("target"))
    return edges.join(versions.select("version_id", "package_id", "version"), "version_id").join(target, "target_id")


def dependent_counts(edges: DataFrame, versions: DataFrame) -> DataFrame:
    """How many packages depend on each, by any of their versions."""
    return edges.join(versions.select("version_id", "package_id"), "version_id").groupBy(F.col("target_id").alias("package_id")).agg(F.count_distinct("package_id").alias("dependents"))


def dependents(edges: DataFrame, versions: DataFrame, packages: DataFrame, limit: int) -> DataFrame:
    """For each package its dependents with the most downloads, which are those of the dependent's latest version."""
    pairs = edges.join(versions.select("version_id", "package_id"), "version_id").select("target_id", "package_id").distinct()
    newest = latest(versions).select("package_id", "version", F.coalesce("downloads", F.lit(0)).alias("downloads"))
    named = pairs.join(packages.select("package_id", "name"), "package_id").join(newest, "package_id", "left")
    return top_by(named, ["target_id"], limit, F.col("downloads").desc_nulls_last(), F.col("name"))


def depending_versions(edges: DataFrame, versions: DataFrame) -> DataFrame:
    """The newest version of each dependent that depends on each package."""
    joined = edges.select("version_id", "target_id").distinct().join(versions, "version_id")
    return first_by(joined, ["target_id", "package_id"], *newest_first())


def synced(versions: DataFrame, edges: DataFrame) -> DataFrame:
    """Whether dependencies of each version are known."""
    known = edges.select("version_id").distinct().withColumn("known", F.lit(True))
    return versions.join(known, "version_id", "left").select("version_id", F.coalesce("known", F.lit(False)).alias("dependencies_synced"))


def timeline(versions: DataFrame, as_of: Column) -> DataFrame:
    """Versions with their age in whole days."""
    age = (F.unix_timestamp(as_of) - F.unix_timestamp(F.col("published_at").cast("timestamp"))) / 86400
    return versions.withColumn("age_days", F.floor(age).cast("long"))


def compare_counts(versions: DataFrame, edges: DataFrame) -> DataFrame:
    """For the latest version of each package: its dependencies, its optional ones, and the package's dependents."""
    newest = latest(versions).select("package_id", "version_id", "version")
    own = edges.groupBy("version_id").agg(F.count("*").alias("dependencies"), F.count_if("optional").alias("optional_dependencies"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return newest.join(own, "version_id", "left").join(dependent_counts(edges, versions), "package_id", "left").select("package_id", "version", zero("dependencies"), zero("optional_dependencies"), zero("dependents"))
