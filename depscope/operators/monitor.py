"""State of the index: jobs, failures, latencies and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BACKGROUND_PRIORITY = 50
MAX_ATTEMPTS = 3


def queue_counts(jobs: DataFrame, as_of: Column) -> DataFrame:
    pending = F.col("status") == "pending"
    return jobs.agg(
        F.count_if(pending & (F.col("requested_at") <= as_of)).alias("due"), F.count_if(pending & (F.col("requested_at") > as_of)).alias("delayed"), F.count_if(pending & (F.col("attempts") > 0)).alias("retrying"),
        F.count_if(F.col("status") == "running").alias("running"), F.count_if(F.col("status") == "failed").alias("failed"),
    )


def retry_distribution(jobs: DataFrame) -> DataFrame:
    """How many jobs in flight and failed had one, two, and three attempts or more."""
    flight, failed = F.col("status").isin("pending", "running"), F.col("status") == "failed"
    n = F.col("attempts")
    return jobs.agg(*[F.count_if(s & t).alias(f"{a}_{b}") for a, s in (("in_flight", flight), ("failed", failed)) for b, t in (("1", n == 1), ("2", n == 2), ("3_or_more", n >= 3))])


def failures_by_scope(jobs: DataFrame) -> DataFrame:
    return jobs.where("status = 'failed'").groupBy("scope").agg(F.count("*").alias("failures"))


def recent_errors(jobs: DataFrame, limit: int) -> DataFrame:
    return jobs.where("last_error IS NOT NULL AND last_error <> ''").orderBy(F.desc_nulls_last("finished_at"), F.desc("job_id")).limit(limit).select("job_id", "last_error", "finished_at")


def gauges(jobs: DataFrame) -> DataFrame:
    pending = F.col("status") == "pending"
    return jobs.agg(F.count_if(pending).alias("pending"), F.count_if(F.col("status") == "running").alias("running"), F.count_if(pending & (F.col("priority") >= BACKGROUND_PRIORITY)).alias("background"), F.count_if(pending & (F.col("priority") < BACKGROUND_PRIORITY)).alias("interactive"))


def pending_by_scope(jobs: DataFrame) -> DataFrame:
    return jobs.where("status = 'pending'").groupBy("scope").agg(F.count("*").alias("pending"))


def eta(jobs: DataFrame, as_of: Column, days: int = 30, least: int = 3) -> DataFrame:
    """Mean duration of jobs finished in the last days, by scope, and the estimate that needs at least so many."""
    done = jobs.where((F.col("status") == "finished") & (F.col("finished_at") >= as_of - F.make_dt_interval(F.lit(days))))
    seconds = F.unix_timestamp(F.col("finished_at").cast("timestamp")) - F.unix_timestamp(F.col("requested_at").cast("timestamp"))
    means = done.groupBy("scope").agg(F.count("*").alias("finished"), F.avg(seconds).alias("mean_seconds"))
    return means.withColumn("estimate", F.when(F.col("finished") >= least, F.greatest(F.lit(1), F.least(F.lit(86_400), F.round("mean_seconds").cast("long"))))).withColumn("estimate", F.col("estimate").cast("long"))


def operations(invocations: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Calls, mean latency, error and hit rates of the last hours; rates are null without calls."""
    recent = invocations.where((F.col("created_at") > as_of - F.make_dt_interval(F.lit(0), F.lit(hours))) & (F.col("created_at") <= as_of))
    share = lambda c: F.when(F.count("*") > 0, F.count_if(c) / F.count("*"))
    return recent.agg(F.count("*").alias("calls"), F.avg("latency_ms").alias("mean_latency"), share(~F.col("success")).alias("error_rate"), share(F.col("hit")).alias("hit_rate"))


def nearest_rank(df: DataFrame, keys: list[str], value: str, share: float = 0.95) -> DataFrame:
    """The value at rank ceil(share * n) of each group."""
    return df.groupBy(*keys).agg(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {value})").alias("value"), F.count("*").alias("n"))


def claim(jobs: DataFrame, as_of: Column) -> DataFrame:
    """The next due job, as it is once claimed: running, with one attempt more. The writer must be single."""
    due = jobs.where((F.col("status") == "pending") & (F.col("requested_at") <= as_of))
    return due.orderBy("priority", "attempts", "requested_at", "job_id").limit(1).withColumns({"status": F.lit("running"), "attempts": F.col("attempts") + 1})


def claimed_per_scope(jobs: DataFrame, as_of: Column) -> DataFrame:
    from .lookup import first_by

    due = jobs.where((F.col("status") == "pending") & (F.col("requested_at") <= as_of))
    return first_by(due, ["scope"], F.col("priority"), F.col("attempts"), F.col("requested_at"), F.col("job_id")).withColumns({"status": F.lit("running"), "attempts": F.col("attempts") + 1})


def advanced(jobs: DataFrame, outcomes: DataFrame, as_of: Column, delay: Column) -> DataFrame:
    """Jobs after the outcomes (job_id, ok, error): finished, failed for good after MAX_ATTEMPTS, or pending again after a delay."""
    joined = jobs.join(outcomes.select("job_id", "ok", "error"), "job_id", "left")
    told, running = F.col("ok").isNotNull() & (F.col("status") == "running"), F.col("status") == "running"
    terminal = ~F.col("ok") & (F.col("attempts") >= MAX_ATTEMPTS)
    status = F.when(told & F.col("ok"), "finished").when(told & terminal, "failed").when(told, "pending").otherwise(F.col("status"))
    again = told & ~F.col("ok") & ~terminal
    return joined.withColumns({"status": status, "requested_at": F.when(again, as_of + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), delay)).otherwise(F.col("requested_at")), "finished_at": F.when(told & ~again & running, as_of).otherwise(F.col("finished_at")), "last_error": F.when(told & ~F.col("ok"), F.col("error")).otherwise(F.col("last_error"))}).drop("ok", "error")
