"""Incremental forms of the daily aggregates with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """(day, event_type, n) of tumbling days; rows later than ``delay`` are dropped."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("day"), "event_type", "n")


def lookback_counts(events: DataFrame, delay: str = "1 day", days: int = 7) -> DataFrame:
    """(until, event_type, n) over ``days`` days, sliding by one."""
    w = F.window("ts", f"{days} days", "1 day").alias("w")
    return events.withWatermark("ts", delay).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.end").alias("until"), "event_type", "n")


def dedupe(events: DataFrame, keys: list[str], delay: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)
