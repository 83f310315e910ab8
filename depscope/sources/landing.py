"""Readers of landed registry data: JSON metadata, advisory feeds, source trees, documentation and manifests.

Fetching is outside: files land in a folder, Spark reads them with a fixed schema.
"""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

PACKAGE_SCHEMA = """package struct<name:string, description:string, repository:string, documentation:string, homepage:string, max_version:string, categories:array<string>, keywords:array<string>>,
    versions array<struct<num:string, created_at:timestamp, yanked:boolean, downloads:long, rust_version:string, checksum:string, license:string, features:map<string,array<string>>>>"""
DEPENDENCY_SCHEMA = "package string, version string, dependencies array<struct<name:string, req:string, kind:string, optional:boolean, features:array<string>>>"
OSV_SCHEMA = """package string, vulns array<struct<id:string, aliases:array<string>, summary:string, withdrawn:string, severity:array<struct<type:string, score:string>>, database_specific:struct<severity:string>,
    affected:array<struct<ranges:array<struct<type:string, events:array<map<string,string>>>>, versions:array<string>, functions:array<string>>>>>"""
RELEASE_SCHEMA = "package string, releases array<struct<tag_name:string, name:string, body:string, published_at:timestamp, draft:boolean, prerelease:boolean>>"
MAX_SOURCE_BYTES = 524_288


def packages(spark: SparkSession, path: str) -> DataFrame:
    """One row per package, with the version to show: the declared newest if listed, else the first not yanked, else the first."""
    df = spark.read.schema(PACKAGE_SCHEMA).json(path)
    nums = F.transform("versions", lambda v: v["num"])
    live = F.filter("versions", lambda v: ~F.coalesce(v["yanked"], F.lit(False)))
    shown = F.coalesce(F.when(F.array_contains(nums, F.col("package.max_version")), F.col("package.max_version")), F.get(live, F.lit(0))["num"], F.get(nums, F.lit(0)))
    return df.select("package.*", shown.alias("shown_version"))


def versions(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(PACKAGE_SCHEMA).json(path)
    return df.select(F.col("package.name").alias("package"), F.explode("versions").alias("v")).select("package", "v.*")


def features(spark: SparkSession, path: str) -> DataFrame:
    """(package, num, feature, target, is_dependency): dep: targets name dependencies, others features."""
    one = versions(spark, path).select("package", "num", F.explode("features").alias("feature", "targets")).select("package", "num", "feature", F.explode_outer("targets").alias("target"))
    return one.withColumn("is_dependency", F.coalesce(F.col("target").startswith("dep:"), F.lit(False))).withColumn("target", F.regexp_replace("target", "^dep:", ""))


def dependencies(spark: SparkSession, path: str) -> DataFrame:
    """Edges with a name; the kind is normal if none is given."""
    df = spark.read.schema(DEPENDENCY_SCHEMA).json(path).select("package", "version", F.explode("dependencies").alias("d"))
    return df.select("package", "version", "d.*").where(F.trim("name") != "").withColumn("kind", F.coalesce(F.nullif(F.trim("kind"), F.lit("")), F.lit("normal")))


def osv(spark: SparkSession, path: str) -> DataFrame:
    """One row per vulnerability: identity, label, range text, fixed versions and functions.

    Its own id if that is a RUSTSEC one, else the first such alias unless it is withdrawn.
    """
    df = spark.read.schema(OSV_SCHEMA).json(path).select("package", F.explode("vulns").alias("v")).select("package", "v.*")
    alias = F.get(F.filter(F.coalesce("aliases", F.array()), lambda a: a.startswith("RUSTSEC-")), F.lit(0))
    ranges = F.flatten(F.transform("affected", lambda a: F.coalesce(a["ranges"], F.array())))
    event = lambda e: F.when(F.size(e) == 1, F.concat(F.map_keys(e)[0], F.lit("="), F.map_values(e)[0]))
    whole = lambda r: F.exists(r["events"], lambda e: F.size(e) != 1)
    text = F.array_join(F.transform(ranges, lambda r: F.when(whole(r), "osv_invalid_event").otherwise(F.concat(r["type"], F.lit("("), F.array_join(F.transform(r["events"], event), "; "), F.lit(")")))), "; ")
    fixed = F.filter(F.flatten(F.transform(ranges, lambda r: F.transform(r["events"], lambda e: e["fixed"]))), lambda x: x.isNotNull())
    functions = F.flatten(F.transform("affected", lambda a: F.coalesce(a["functions"], F.array())))
    return df.select(
        "package", F.when(F.col("id").startswith("RUSTSEC-") | F.col("withdrawn").isNotNull(), F.col("id")).otherwise(F.coalesce(alias, "id")).alias("advisory_id"), F.col("summary").alias("title"),
        X.severity_label(F.col("database_specific.severity"), F.get("severity", F.lit(0))["score"]).alias("severity"),
        F.when(F.col("withdrawn").isNotNull(), F.concat(F.lit("withdrawn="), "withdrawn")).otherwise(F.when(F.coalesce(text, F.lit("")) == "", "osv_affected_unknown").otherwise(text)).alias("affected_range"),
        F.array_sort(F.array_distinct(fixed)).alias("fixed_versions"), F.array_sort(F.array_distinct(functions)).alias("affected_functions"),
        F.array_distinct(F.flatten(F.transform("affected", lambda a: F.coalesce(a["versions"], F.array())))).alias("versions"),
    )


def releases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RELEASE_SCHEMA).json(path).select("package", F.explode("releases").alias("r")).select("package", "r.*").where("NOT draft").drop("draft")


def source_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Text files of a tree: at most MAX_SOURCE_BYTES, without zero bytes, valid UTF-8; with their hash."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).where(F.col("length") <= MAX_SOURCE_BYTES)
    text = F.col("content").cast("string")
    return df.where(F.is_valid_utf8(text) & (F.instr(text, "\x00") == 0)).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), text.alias("text"))


def readmes(spark: SparkSession, path: str, limit: int = 1_000_000) -> DataFrame:
    """README texts, blank ones as null, cut at the limit."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return df.select("path", F.when(F.trim("value") != "", F.substring("value", 1, limit)).alias("readme"))


def documentation(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Title, text and links of landed pages."""
    return pages.select(F.col(url).alias("url"), X.html_title(F.col(html)).alias("title"), X.strip_html(F.col(html)).alias("content"), X.hrefs(F.col(html)).alias("links"))


def advisory_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Advisory files with TOML front matter between +++ or --- lines (or a fenced block), and the first heading of the body."""
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("path"), "value")
    pattern = r"(?s)^\s*(?:```toml|\+\+\+|---)\r?\n(.*?)\r?\n(?:```|\+\+\+|---)\s*\r?\n?(.*)$"
    body = F.regexp_extract("value", pattern, 2)
    return df.where(F.col("value").rlike(pattern)).select("path", F.regexp_extract("value", pattern, 1).alias("front_matter"), F.nullif(F.regexp_extract(body, r"(?m)^#\s+(.+)$", 1), F.lit("")).alias("title"), body.alias("body"))


def manifest(spark: SparkSession, text: str) -> tuple[str | None, str | None, DataFrame]:
    """(package name, toolchain floor, dependencies) of one manifest. All sections count, target-specific ones included; of
    entries that differ in case only, one with a requirement wins; * asks for nothing."""
    found = tomllib.loads(text)
    tables = [found, *found.get("target", {}).values()]
    best: dict[str, tuple[str, str | None]] = {}
    for t in tables:
        for section in ("dependencies", "dev-dependencies", "build-dependencies"):
            for name, spec in t.get(section, {}).items():
                name = (spec.get("package") if isinstance(spec, dict) else None) or name
                wanted = spec if isinstance(spec, str) else spec.get("version")
                wanted = None if wanted in (None, "*", "") else wanted
                if name.lower() not in best or best[name.lower()][1] is None:
                    best[name.lower()] = (name, wanted)
    package = found.get("package", {})
    return package.get("name"), package.get("rust-version"), spark.createDataFrame(sorted(best.values()), "name string, requirement string")
