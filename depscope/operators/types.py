"""Implementations of types and traits: ranked rows, one row for each identity, and reports by type and by trait."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookup import first_by

#: Order of the kinds of implementations; fixed values, others come last.
KINDS = ("inherent", "derive", "trait")


def methods() -> Column:
    """An implementation's methods; none known is an empty list."""
    return F.coalesce("methods", F.array().cast("array<string>"))


def with_written(impls: DataFrame) -> DataFrame:
    """impls with the written type, and whether a row is synthetic or negative; where these aren't known they are null and false."""
    for name, value in (("type_display", F.lit(None).cast("string")), ("is_synthetic", F.lit(False)), ("is_negative", F.lit(False))):
        if name not in impls.columns:
            impls = impls.withColumn(name, value)
    return impls


def kind_rank() -> Column:
    rank = F.lit(len(KINDS))
    for i, kind in enumerate(KINDS):
        rank = F.when(F.col("impl_kind") == kind, i).otherwise(rank)
    return rank


def source_rank() -> Column:
    """Documented rows with content first, then other documented rows, then parsed ones."""
    documented = F.col("index_source") == "documented"
    full = (F.size(methods()) > 0) | F.col("trait_display").isNotNull() | F.col("is_blanket") | F.col("is_synthetic") | F.col("is_negative")
    return F.when(documented & full, 0).when(documented, 1).otherwise(2)


def implementations(impls: DataFrame, traits: list[str] | None = None, types: list[str] | None = None) -> DataFrame:
    """Rows of the given traits or types, ignoring case, with the ranks that order them."""
    for column, names in (("trait_name", traits), ("type_name", types)):
        if names is not None:
            impls = impls.where(F.lower(column).isin([n.lower() for n in names]))
    return with_written(impls).select("*", kind_rank().alias("kind_rank"), source_rank().alias("source_rank"))


def priority() -> Column:
    """How much a row says: documented 4, methods 2, a written form, bounds and a blanket 1 each."""
    one = lambda c, n=1: F.when(c, n).otherwise(0)
    return one(F.col("index_source") == "documented", 4) + one(F.size(methods()) > 0, 2) + one(F.col("trait_display").isNotNull()) + one(F.col("has_bounds")) + one(F.col("is_blanket"))


def one_of_each(impls: DataFrame) -> DataFrame:
    """Of rows that implement the same trait in the same way for the same written type, the one that says most; the first of equal ones."""
    low = lambda c: F.coalesce(F.lower(c), F.lit("")).alias(f"key_{c}")
    written = ("type_name", "type_display", "trait_name", "trait_display")
    keyed = with_written(impls).select("*", *[low(c) for c in written])
    keys = ["release", *[f"key_{c}" for c in written], "impl_kind"]
    order = [priority().desc(), kind_rank(), source_rank(), F.col("type_name"), F.col("start_line"), F.col("impl_id")]
    return first_by(keyed, keys, *order).drop(*[f"key_{c}" for c in written])


def by_type(impls: DataFrame, symbols: DataFrame) -> DataFrame:
    """For each type of a release: methods of its own, implementations beside, the traits, and where the best row defines it."""
    rows = one_of_each(impls).withColumn("key", F.lower("type_name"))
    own = F.col("impl_kind") == "inherent"
    counted = rows.groupBy("release", "key").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.when(own, methods()))))).alias("methods"),
        F.count_if(~own).alias("others"), F.sort_array(F.collect_set(F.lower("trait_name"))).alias("traits"),
    )
    best = first_by(symbols.withColumn("key", F.lower("name")), ["release", "key"], F.when(F.col("visibility") == "public", 0).otherwise(1), F.when((F.col("index_source") == "documented") & F.col("path").isNotNull(), 0).otherwise(1), F.col("start_line"), F.col("symbol_id"))
    return counted.join(best.select("release", "key", "symbol_id", "path"), ["release", "key"], "left")


def by_trait(impls: DataFrame) -> DataFrame:
    """For each trait of a release: how many types have it, by derivation, and how many implementations are blanket ones."""
    rows = one_of_each(impls).where("trait_name IS NOT NULL").withColumn("key", F.lower("trait_name"))
    return rows.groupBy("release", "key").agg(F.count_distinct(F.lower("type_name")).alias("types"), F.count_if(F.col("impl_kind") == "derive").alias("derived"), F.count_if("is_blanket").alias("blanket"))
