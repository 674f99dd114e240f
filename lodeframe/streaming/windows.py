"""Event-time aggregations that run on batches and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_event_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with a zone; the tables' times have none and are taken as UTC,
    the session's zone."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def _opened(df: DataFrame, window: str, *keys: str) -> DataFrame:
    return df.select(F.col(f"{window}.start").cast("timestamp_ntz").alias("start"), *keys, "n", "total")


def tumbling_counts(events: DataFrame, size: str, *keys: str) -> DataFrame:
    return _opened(events.groupBy(F.window("ts", size).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")), "w", *keys)


def sliding_counts(events: DataFrame, size: str, slide: str, *keys: str) -> DataFrame:
    return _opened(events.groupBy(F.window("ts", size, slide).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")), "w", *keys)


def session_counts(events: DataFrame, gap: str, key: str) -> DataFrame:
    sessions = events.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return sessions.select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
