"""Event-time windows in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.plans.registry import query, table
from lodeframe.streaming.windows import session_counts, sliding_counts, tumbling_counts, with_event_time


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def eventtime_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tumbling_counts(with_event_time(table(spark, sf_dir, "events")), "1 hour", "event_type")


@query("""SELECT (date_trunc('hour', ts) - o * INTERVAL 1 HOUR)::TIMESTAMP AS start, event_type, count(*) AS n, sum(value) AS total FROM events, (VALUES (0), (1)) AS t(o) GROUP BY 1, 2""")
def eventtime_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliding_counts(with_event_time(table(spark, sf_dir, "events")), "2 hours", "1 hour", "event_type")


@query("""SELECT user_id, min(ts)::TIMESTAMP AS start, count(*) AS n FROM (
 SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
  SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def eventtime_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_counts(with_event_time(table(spark, sf_dir, "events")), "6 hours", "user_id")


@query("SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, sum(value) AS total, max(ts)::TIMESTAMP AS last_seen FROM events WHERE event_type <> 'error' GROUP BY 1, 2")
def eventtime_daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")
    return table(spark, sf_dir, "events").where("event_type <> 'error'").groupBy("user_id", day).agg(F.sum("value").alias("total"), F.max("ts").alias("last_seen"))
