"""Structured Streaming, over the tables' files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.plans.registry import query, table
from lodeframe.streaming.profiles import profiles, silences
from lodeframe.streaming.runner import Feed, read_stream, state_counts, to_table
from lodeframe.streaming.stateful import running_totals, sessions_by_timers
from lodeframe.streaming.windows import session_counts, sliding_counts, tumbling_counts, with_event_time


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_event_time(read_stream(spark, sf_dir, "events"))


def _quarters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[DataFrame]]:
    """The events with the quarter of their time span, and one part for each, in four files."""
    events = table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = (x or 0 for x in events.agg(F.min(at), F.max(at)).first())
    dealt = events.withColumn("quarter", F.least(F.lit(3), F.floor(4 * (at - low) / max(1, high - low))))
    return dealt, [_dealt(dealt.where(F.col("quarter") == k).select(*events.columns)) for k in range(4)]


def _dealt(part: DataFrame) -> DataFrame:
    """A part in four files, its rows in no order of time."""
    return part.repartition(4, F.xxhash64("event_id"))


def _in_five(spark: SparkSession, sf_dir: str) -> Feed:
    """The quarters, and then some of the first again, far behind the watermark."""
    dealt, parts = _quarters(spark, sf_dir)
    late = dealt.where((F.col("quarter") == 0) & (F.col("event_type") == "click")).select(*parts[0].columns)
    return Feed([*parts, _dealt(late)], "batches")


def _times(feed: Feed) -> DataFrame:
    return with_event_time(feed.stream())


_CLOSED = "start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query(f"SELECT * FROM (SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2) WHERE {_CLOSED}")
def stream_late_rows_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five batches, the last of rows behind the watermark: they change no window, and a window is
    given once the watermark has passed its end."""
    feed = _in_five(spark, sf_dir)
    return to_table(tumbling_counts(_times(feed).withWatermark("ts", "1 hour"), "1 hour", "event_type"), "append", feed)


_QUARTER = "least(3, floor(4 * (epoch_us(ts) - min(epoch_us(ts)) OVER ()) / greatest(1, max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER ())))"


@query(f"SELECT count(DISTINCT date_trunc('hour', ts)) AS dropped FROM (SELECT *, {_QUARTER} AS quarter FROM events) WHERE quarter = 0 AND event_type = 'click'")
def stream_late_rows_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine's own count of what came too late: rows of the last part, which reach the state as one for each window."""
    feed, progress = _in_five(spark, sf_dir), []
    to_table(tumbling_counts(_times(feed).withWatermark("ts", "1 hour"), "1 hour", "event_type"), "append", feed, progress=progress)
    return spark.createDataFrame([(state_counts(progress, "numRowsDroppedByWatermark"),)], "dropped long")


@query("""SELECT start, event_type, n, total FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2)""")
def stream_state_over_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update mode over five batches: a window that several batches change is given several times."""
    feed = _in_five(spark, sf_dir)
    changes = to_table(tumbling_counts(_times(feed).withWatermark("ts", "1 hour"), "1 day", "event_type"), "update", feed)
    return changes.groupBy("start", "event_type").agg(F.max("n").alias("n"), F.max_by("total", "n").alias("total"))


_SESSIONS = """SELECT user_id, start, n FROM (SELECT user_id, session, min(ts)::TIMESTAMP AS start, max(ts) AS last, count(*) AS n FROM (
 SELECT user_id, ts, sum(CASE WHEN ts > before + INTERVAL 6 HOUR OR before IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events)) GROUP BY 1, 2)
 WHERE last + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""


@query(_SESSIONS)
def stream_sessions_over_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that the watermark has closed, over five batches."""
    feed = _in_five(spark, sf_dir)
    return to_table(session_counts(_times(feed).withWatermark("ts", "1 hour"), "6 hours", "user_id"), "append", feed)


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def stream_tumbling_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_table(tumbling_counts(_events(spark, sf_dir).withWatermark("ts", "1 hour"), "1 hour", "event_type"), "complete")


@query("SELECT (date_trunc('hour', ts) - o * INTERVAL 1 HOUR)::TIMESTAMP AS start, event_type, count(*) AS n, sum(value) AS total FROM events, (VALUES (0), (1)) AS t(o) GROUP BY 1, 2")
def stream_sliding_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_table(sliding_counts(_events(spark, sf_dir).withWatermark("ts", "1 hour"), "2 hours", "1 hour", "event_type"), "complete")


@query(f"SELECT * FROM (SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2) WHERE {_CLOSED}")
def stream_tumbling_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has passed; the last ones stay open."""
    return to_table(tumbling_counts(_events(spark, sf_dir).withWatermark("ts", "1 hour"), "1 hour", "event_type"), "append")


@query(_SESSIONS)
def stream_session_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_table(session_counts(_events(spark, sf_dir).withWatermark("ts", "1 hour"), "6 hours", "user_id"), "append")


@query("SELECT DISTINCT user_id FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_table(_events(spark, sf_dir).select("user_id").dropDuplicates(["user_id"]), "append")


@query("SELECT event_id, c_mktsegment FROM events JOIN customer ON user_id = c_custkey")
def stream_static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return to_table(_events(spark, sf_dir).join(people, F.col("user_id") == F.col("c_custkey")).select("event_id", "c_mktsegment"), "append")


@query("""SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR""")
def stream_stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides have watermarks, so state is dropped once no partner can come."""
    a = _events(spark, sf_dir).where("event_type = 'click'").withWatermark("ts", "1 hour").alias("a")
    b = _events(spark, sf_dir).where("event_type = 'purchase'").withWatermark("ts", "1 hour").alias("b")
    near = F.expr("a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR")
    return to_table(a.join(b, near).select(F.col("a.event_id").alias("a_id"), F.col("b.event_id").alias("b_id")), "append")


@query("SELECT user_id, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1")
def stream_custom_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals by arbitrary state; the last of each key is its total."""
    totals = to_table(running_totals(_events(spark, sf_dir).select("user_id", "value")), "append")
    return totals.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 6).alias("total"))


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def stream_tumbling_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update mode gives a window again whenever it changes; the largest count is its last."""
    changes = to_table(tumbling_counts(_events(spark, sf_dir).withWatermark("ts", "1 hour"), "1 hour", "event_type"), "update")
    return changes.groupBy("start", "event_type").agg(F.max("n").alias("n"), F.max_by("total", "n").alias("total"))


def repeated(spark: SparkSession, sf_dir: str) -> Feed:
    """The quarters; each holds its last day's events twice, the second time a little later, and the next one holds them again:
    all within the watermark's delay of two days, so that only the state can tell."""
    dealt, parts = _quarters(spark, sf_dir)
    again = []
    for k in range(4):
        own = dealt.where(F.col("quarter") == k)
        last = own.join(F.broadcast(own.agg(F.max("ts").alias("__end"))), F.col("ts") > F.col("__end") - F.expr("INTERVAL 1 DAY"))
        again.append(last.withColumn("ts", F.col("ts") + F.expr("INTERVAL 10 MINUTE")).select(*parts[k].columns))
    fed = [parts[0].unionByName(again[0])] + [parts[k].unionByName(again[k]).unionByName(again[k - 1]) for k in range(1, 4)]
    return Feed([_dealt(p) for p in fed], "repeats")


def deduplicated(feed: Feed, progress: list[dict] | None = None) -> DataFrame:
    once = _times(feed).select("event_id", "ts").withWatermark("ts", "2 days").dropDuplicatesWithinWatermark(["event_id"])
    return to_table(once.select("event_id"), "append", feed, progress=progress)


@query("SELECT event_id FROM events")
def stream_dedup_within_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats inside the watermark's delay; state is kept for that long only."""
    return deduplicated(repeated(spark, sf_dir))


@query(_SESSIONS)
def stream_sessions_by_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions kept as arbitrary state over five batches and closed by event-time timers."""
    feed = _in_five(spark, sf_dir)
    closed = to_table(sessions_by_timers(_times(feed).withWatermark("ts", "1 hour"), 6 * 3600), "append", feed)
    return closed.select("user_id", F.timestamp_micros("start").cast("timestamp_ntz").alias("start"), "n")


@query("""SELECT event_type, count(*) AS n, string_agg(event_id, '-' ORDER BY ts, event_id) FILTER (WHERE place <= 3) AS latest, max(of_day) AS commonest FROM (
 SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS place, count(*) OVER (PARTITION BY event_type, dayofweek(ts)) AS of_day FROM events) GROUP BY 1""")
def stream_typed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value, list and map state in RocksDB over four parts, resumed from the checkpoint for each."""
    feed = Feed(_quarters(spark, sf_dir)[1], "profiles")
    changes = to_table(profiles(_times(feed)), "update", feed, rocksdb=True, once=True)
    return changes.groupBy("event_type").agg(F.max("n").alias("n"), F.max_by("latest", "n").alias("latest"), F.max_by("commonest", "n").alias("commonest"))


@query(f"""WITH dealt AS (SELECT *, user_id % 16 AS key, {_QUARTER} AS quarter FROM events),
 ends AS (SELECT quarter, max(ts) - INTERVAL 1 HOUR AS mark FROM dealt GROUP BY 1),
 parts AS (SELECT key, quarter, max(ts) AS last, count(*) AS n FROM dealt GROUP BY ALL),
 marks AS (SELECT k.key, e.quarter, coalesce(p.n, 0) AS n, max(p.last) OVER (PARTITION BY k.key ORDER BY e.quarter) AS last, e.mark FROM (SELECT DISTINCT key FROM dealt) k CROSS JOIN ends e LEFT JOIN parts p ON p.key = k.key AND p.quarter = e.quarter),
 due AS (SELECT *, last IS NOT NULL AND last + INTERVAL 30 MINUTE <= mark AS over FROM marks),
 grouped AS (SELECT *, coalesce(sum(over::INT) OVER (PARTITION BY key ORDER BY quarter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stretch FROM due)
 SELECT key, max(last)::TIMESTAMP AS last, sum(n)::BIGINT AS n FROM grouped GROUP BY key, stretch HAVING bool_or(over) AND sum(n) > 0""")
def stream_silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of users that fell silent for half an hour, by timers of typed state that outlive restarts."""
    feed = _in_five(spark, sf_dir)
    over = to_table(silences(_times(feed).withWatermark("ts", "1 hour"), F.col("user_id") % 16, 1800), "append", feed, rocksdb=True)
    return over.select("key", F.timestamp_micros("last").cast("timestamp_ntz").alias("last"), "n")
