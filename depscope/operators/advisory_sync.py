"""What feeds of advisories say, put in place of what they said before: for each package and source on its own."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import snapshot

#: What tells rows apart; an advisory of the whole package has no version.
KEYS = ["package_id", "source", "advisory_id", "version_id"]
SOURCES = ("osv", "rustsec_db", "ghsa")


@dataclass
class Synced:
    """rows: the advisory rows now. stamps: (package_id, checked_at). outcome: one row for each source."""

    rows: DataFrame
    stamps: DataFrame
    outcome: DataFrame

    def publish(self, root: str, version: int) -> str:
        """Rows and stamps as one snapshot: readers see both or neither."""
        return snapshot.publish_together({"rows": self.rows, "stamps": self.stamps}, root, version)


def synced(rows: DataFrame, feed: DataFrame, answers: DataFrame, stamps: DataFrame, now: Column, sources: tuple[str, ...] = SOURCES) -> Synced:
    """The next state of advisory rows (KEYS and others) after a round of questions to their sources.

    answers: (package_id, source, ok, message), one or more for each question; a question is answered if all are ok. Then
    the rows of this package and source are cleared, and those of the feed, in the columns of rows, take their place; of
    rows with equal keys, nulls included, the greatest stays. Where a question failed, the old rows stay and what the
    feed has of it is left out. A package is stamped now if every one of the sources answered; else its stamp stays.
    """
    asked = answers.where(F.col("source").isin(*sources)).groupBy("package_id", "source").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("ok"), F.max("message").alias("message"))
    good = asked.where("ok").select("package_id", "source")
    others = [c for c in rows.columns if c not in KEYS]
    fresh = feed.select(*rows.columns).join(good, ["package_id", "source"], "left_semi").groupBy(*KEYS).agg(F.max(F.struct(*others)).alias("row")).select(*KEYS, "row.*").select(*rows.columns)
    kept = rows.join(good, ["package_id", "source"], "left_anti")
    complete = good.groupBy("package_id").agg(F.count("*").alias("n")).where(F.col("n") == len(set(sources))).select("package_id", now.alias("now"))
    dated = stamps.select("package_id", "checked_at").join(complete, "package_id", "full_outer").select("package_id", F.coalesce("now", "checked_at").alias("checked_at"))
    count = lambda df, name: df.groupBy("source").agg(F.count("*").alias(name))
    outcome = asked.groupBy("source").agg(F.count_if("ok").alias("answered"), F.count_if(~F.col("ok")).alias("failed"), F.array_sort(F.collect_set(F.when(~F.col("ok"), F.substring("message", 1, 200)))).alias("messages"))
    cleared = rows.join(good, ["package_id", "source"], "left_semi")
    outcome = outcome.join(count(cleared, "cleared"), "source", "left").join(count(fresh, "written"), "source", "left").na.fill(0, ["cleared", "written"])
    return Synced(kept.select(*rows.columns).unionByName(fresh), dated, outcome)


def latest(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(rows, stamps) of the newest snapshot that was published to its end."""
    found = snapshot.current_together(spark, root, ["rows", "stamps"])
    return found["rows"], found["stamps"]
