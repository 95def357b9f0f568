"""Event-time windows that hold alike for tables and streams; an extension of this engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def sliding(events: DataFrame, length: str, step: str | None, late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, total of windows; tumbling without ``step``.  Rows later than ``late`` are left out of a stream."""
    span = F.window("ts", length, step) if step else F.window("ts", length)
    out = _timed(events, late).groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,2)")).cast("double"), 2).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """user_id, start and n of runs of events that lie less than ``gap`` apart."""
    out = _timed(events, late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")
