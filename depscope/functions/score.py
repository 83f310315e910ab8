"""Scores and labels as arithmetic columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def adoption(yanked: Column, downloads: Column) -> Column:
    return F.when(yanked, "deprecated").when(downloads >= 1_000_000, "high").when(downloads >= 100_000, "medium").otherwise("low")


def maintenance(downloads: Column, dependents: Column, features: Column, has_floor: Column, dependencies: Column, advisories: Column, yanked: Column) -> Column:
    """0 to 100: adoption and features add, dependencies, advisories and a yanked version take away."""
    flag = lambda c: F.when(c, 1).otherwise(0)
    raw = 50 + 8 * F.log10(downloads + 1) + 10 * F.log10(dependents + 1) + 0.2 * F.least(features, F.lit(20)) + 2 * flag(has_floor) - 0.15 * dependencies - 12 * advisories - 40 * flag(yanked)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))


def alternative(similarity: Column, categories: Column, keywords: Column, downloads: Column, dependents: Column, days: Column, advisories: Column, yanked: Column, policy: Column) -> Column:
    """How good an alternative a package is."""
    flag = lambda c: F.when(c, 1).otherwise(0)
    recency = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(2.0), 2 - days / 365)), F.lit(0.0))
    return (
        F.least(4 * similarity, F.lit(4.0)) + 1.5 * categories + keywords + 0.15 * F.log(downloads + 1) + 0.20 * F.log(dependents + 1) + recency
        - 1.25 * advisories - 5 * flag(yanked) - 8 * flag(policy == "denied") - flag(policy == "unknown")
    )


#: What alternative() adds at most for a pair that shares these fields and no others.
PAIR = {("category", "keyword"): 6.5, ("category",): 5.5, ("keyword",): 5.0, (): 4.0}
#: How much of that is for a similarity of 1; a lesser one adds its share at most.
SIMILAR = 4.0


def ttl_seconds(releases: Column, days: Column) -> Column:
    """How long a freshness check holds: hours for busy packages, weeks for quiet ones; no known release counts as busy."""
    return F.when((releases >= 24) | (F.coalesce(days, F.lit(0)) < 30), 21_600).when((releases >= 6) | (days < 180), 172_800).when(days > 1825, 5_184_000).otherwise(1_209_600).cast("long")


def retry_delay(attempts: Column) -> Column:
    """Seconds before a failed job runs again, without jitter: doubling from 5, 300 at most."""
    return F.least(5 * F.pow(F.lit(2), F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(5))), F.lit(300)).cast("long")


def jittered(delay: Column, seed: int) -> Column:
    """Up to 15 % more or less, between 1 and 600."""
    return F.greatest(F.lit(1), F.least(F.lit(600), F.round(delay * (0.85 + 0.3 * F.rand(seed))))).cast("long")
