"""Telemetry as streams: latency by window, sessions, and rolling limits by caller."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """Event files as they land, with an event time that watermarks accept."""
    raw = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def latency_windows(stream: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Calls, errors and mean latency by tool and window; rows later than the watermark are dropped."""
    w = F.window("ts", size)
    out = stream.withWatermark("ts", late).groupBy(w.alias("w"), F.col("event_type").alias("tool"))
    return out.agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("errors"), F.avg("value").alias("mean_latency")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "tool", "calls", "errors", "mean_latency")


def call_sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    w = F.session_window("ts", gap)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("calls")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "calls")


def admitted(stream: DataFrame, gap_seconds: float = 1.0, most: int = 60, window_seconds: float = 120.0, late: str = "10 minutes") -> DataFrame:
    """Two-tier limiter per user: an event is admitted if the last admitted one is gap_seconds ago and fewer than `most`
    were admitted in the last window_seconds. State is the admitted times of one window, so at most `most` numbers."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        for f in frames:
            f = f.sort_values(["ts", "event_id"])
            ok = []
            for t in f["ts"].map(pd.Timestamp.timestamp):
                times = [x for x in times if t - x < window_seconds]
                good = (not times or t - times[-1] >= gap_seconds) and len(times) < most
                ok.append(good)
                if good:
                    times.append(t)
            yield pd.DataFrame({"user_id": f["user_id"], "event_id": f["event_id"], "admitted": ok})
        state.update((times,))
        if times:
            state.setTimeoutTimestamp(max(int((times[-1] + window_seconds) * 1000), state.getCurrentWatermarkMs() + 1))

    kept = stream.withWatermark("ts", late).select("user_id", "event_id", "ts")
    return kept.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, admitted boolean", "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)
