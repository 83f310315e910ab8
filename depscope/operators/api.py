"""The public surface of a release: preferred rows, differences, replacements and places in files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookup import first_by, top_by


def surface(symbols: DataFrame, keys: list[str]) -> DataFrame:
    """One public row for each key: documented rows first, then rows with a signature, then by place."""
    public = symbols.where("visibility = 'public' OR visibility IS NULL")
    return first_by(public, keys, F.when(F.col("index_source") == "documented", 0).otherwise(1), F.when(F.col("signature").isNotNull(), 0).otherwise(1), F.col("start_line"), F.col("end_line"), F.col("symbol_id"))


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes between two surfaces by (name, kind): removed, visibility_changed, signature_changed or added."""
    side = lambda df, p: df.select("name", "kind", F.lit(True).alias(f"{p}_here"), F.trim("signature").alias(f"{p}_signature"), F.lower(F.trim("visibility")).alias(f"{p}_visibility"))
    both = side(old, "old").join(side(new, "new"), ["name", "kind"], "full_outer")
    signature = ~F.col("old_signature").eqNullSafe(F.col("new_signature"))
    visibility = ~F.col("old_visibility").eqNullSafe(F.col("new_visibility"))
    change = F.when(F.col("new_here").isNull(), "removed").when(F.col("old_here").isNull(), "added").when(visibility, "visibility_changed").when(signature, "signature_changed")
    breaking = F.coalesce((F.col("change") == "removed") | (F.col("old_here") & F.col("new_here") & (signature | ((F.col("old_visibility") == "public") & (F.col("new_visibility") == "private")))), F.lit(False))
    rank = F.when(F.col("change") == "removed", 0).when(F.col("change") == "visibility_changed", 1).when(F.col("change") == "signature_changed", 2).otherwise(3)
    return both.withColumn("change", change).where("change IS NOT NULL").withColumn("breaking", breaking).withColumn("rank", rank.cast("long")).select("name", "kind", "change", "breaking", "rank", "old_signature", "new_signature")


def symbol_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def symbol_tokens(name: Column) -> Column:
    """Words of a camel- or snake-case name, lower-cased."""
    return F.filter(F.split(F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+"), lambda w: w != "")


def token_score(a: Column, b: Column) -> Column:
    """Four times the Jaccard index of two token lists, rounded."""
    x, y = symbol_tokens(a), symbol_tokens(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.round(4.0 * F.size(F.array_intersect(x, y)) / union)).otherwise(F.lit(0.0)).cast("long")


def renamed(a: Column, b: Column) -> Column:
    x, y = symbol_key(a), symbol_key(b)
    return (x == y) | ((F.contains(x, y) | F.contains(y, x)) & (F.abs(F.length(x) - F.length(y)) <= 6))


def signature_score(a: Column, b: Column) -> Column:
    """5 for equal texts, else 2 for as many arguments and 1 for both or neither returning."""
    flat = lambda s: F.regexp_replace(F.coalesce(s, F.lit("")), r"\s+", "")
    inner = lambda s: F.regexp_extract(flat(s), r"\((.*?)\)", 1)
    args = lambda s: F.when(inner(s) == "", 0).otherwise(F.size(F.split(inner(s), ",")))
    returns = lambda s: flat(s).contains("->")
    return F.when(flat(a) == flat(b), 5).otherwise(F.when(args(a) == args(b), 2).otherwise(0) + F.when(returns(a) == returns(b), 1).otherwise(0)).cast("long")


def replacements(changes: DataFrame, least: int = 5) -> DataFrame:
    """For each removed symbol the added one of its kind that scores best, `least` at least; ties to the first by name.

    Candidates must share a token with the removed name or its first key letters: an equi-join bounds the pairs.
    """
    tokens = lambda df, c: df.withColumn("token", F.explode(F.array_union(symbol_tokens(F.col(c)), F.array(F.substring(symbol_key(F.col(c)), 1, 4)))))
    gone = tokens(changes.where("change = 'removed'").select(F.col("name").alias("old_name"), "kind", "old_signature"), "old_name")
    came = tokens(changes.where("change = 'added'").select(F.col("name").alias("new_name"), "kind", "new_signature"), "new_name")
    pairs = gone.join(came, ["kind", "token"]).drop("token").distinct()
    score = F.when(renamed(F.col("old_name"), F.col("new_name")), 5).otherwise(0) + token_score(F.col("old_name"), F.col("new_name")) + signature_score(F.col("old_signature"), F.col("new_signature"))
    return first_by(pairs.withColumn("score", score.cast("long")).where(F.col("score") >= least), ["old_name", "kind"], F.desc("score"), F.asc("new_name")).select("old_name", "kind", "new_name", "score")


def action(change: Column) -> Column:
    return F.when(change == "removed", "replace").when(change == "signature_changed", "adapt calls").when(change == "visibility_changed", "stop using").otherwise("none")


def containing(symbols: DataFrame, places: DataFrame, kind: str, within: int = 200) -> DataFrame:
    """For each place (file_id, line) the nearest symbol of the kind that starts at or before it, at most `within` lines away."""
    of = symbols.where(F.col("kind") == kind).select("file_id", F.struct("start_line", "symbol_id", "name").alias("s"))
    near = places.join(of, "file_id").where((F.col("s.start_line") <= F.col("line")) & (F.col("s.start_line") >= F.col("line") - within))
    return near.groupBy("file_id", "line").agg(F.max("s").alias("s")).select("file_id", "line", F.col("s.name").alias("name"), F.col("s.start_line").alias("start_line"))


def nearest(symbols: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """The k symbols of a file nearest to each place by lines.

    Of those that start in one line only the first k can be among them, so that a place meets k for each line of its file.
    """
    some = top_by(symbols.select("file_id", "symbol_id", "name", "start_line"), ["file_id", "start_line"], k, F.col("symbol_id")).drop("place")
    near = places.join(some, "file_id").withColumn("distance", F.abs(F.col("start_line") - F.col("line")))
    return top_by(near, ["file_id", "line"], k, F.col("distance"), F.col("start_line"), F.col("symbol_id"))


def deprecated_items(symbols: DataFrame) -> DataFrame:
    """Deprecated symbols and deprecated types, as one list."""
    gone = symbols.where("deprecated")
    return gone.select("name", "kind", "symbol_id", F.lit("symbol").alias("list")).unionByName(gone.where("kind = 'standard'").select("name", "kind", "symbol_id", F.lit("type").alias("list")))


def error_types(symbols: DataFrame, suffixes: tuple[str, ...] = ("error", "err")) -> DataFrame:
    """Symbols whose names end like an error's."""
    low = F.lower("name")
    test = low.endswith(suffixes[0])
    for s in suffixes[1:]:
        test = test | low.endswith(s)
    return symbols.where(test)
