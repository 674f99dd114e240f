"""Window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeframe.operators.frames import groups_frame
from lodeframe.operators.ranks import counts_in_range
from lodeframe.plans.registry import query, table


def _by_price():
    return Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")


@query("""SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr, ntile(3) OVER w AS tile, percent_rank() OVER w AS pr, cume_dist() OVER w AS cd
 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
def window_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(_by_price()).cast("long").alias("rn"), F.rank().over(v).cast("long").alias("rk"), F.dense_rank().over(v).cast("long").alias("dr"), F.ntile(3).over(_by_price()).cast("long").alias("tile"), F.percent_rank().over(_by_price()).alias("pr"), F.cume_dist().over(_by_price()).alias("cd"))


@query("""SELECT event_id, lag(value, 1, -1) OVER w AS before, lead(value, 2) OVER w AS ahead FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)""")
def window_lag_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts")
    return table(spark, sf_dir, "events").select("event_id", F.lag("value", 1, -1.0).over(w).alias("before"), F.lead("value", 2).over(w).alias("ahead"))


@query("""SELECT o_orderkey, first_value(o_totalprice) OVER w AS first, last_value(o_totalprice) OVER w AS last, nth_value(o_totalprice, 2) OVER w AS second
 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def window_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _by_price().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = "o_totalprice"
    return table(spark, sf_dir, "orders").select("o_orderkey", F.first(p).over(w).alias("first"), F.last(p).over(w).alias("last"), F.nth_value(p, 2).over(w).alias("second"))


@query("""SELECT event_id, avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS moving, sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS running FROM events""")
def window_rows_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts")
    return table(spark, sf_dir, "events").select("event_id", F.avg("value").over(w.rowsBetween(-2, 0)).alias("moving"), F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running"))


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_totalprice RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING) AS near FROM orders")
def window_range_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a few large groups: counted in bins of the price, so that no task holds a group."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    price = F.col("o_totalprice")
    return counts_in_range(orders, ["o_orderstatus", "o_orderpriority"], "o_totalprice", price - 1000, price + 1000, 1000.0, "near").select("o_orderkey", "near")


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_totalprice RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING) AS near FROM orders")
def window_range_frame_of_small_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_totalprice").rangeBetween(-1000, 1000)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.count("*").over(w).alias("near"))


@query("SELECT o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS total FROM orders")
def window_groups_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peers share a dense rank, so a frame of groups is one of ranks."""
    ranked = table(spark, sf_dir, "orders").withColumn("g", F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderdate")))
    return ranked.select("o_orderkey", F.sum("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("g").rangeBetween(-1, 0)).alias("total"))


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW) AS others FROM orders")
def window_exclude_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.count("*").over(Window.partitionBy("o_custkey")) - 1).alias("others"))


def _groups_query(exclude: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), F.round("o_totalprice").cast("long").alias("price"), F.floor(F.col("o_orderkey") % 4).alias("rank"))
        return groups_frame(orders, ["o_custkey"], "rank", "price", 1, 2, exclude).select("o_orderkey", "n", "total", "low", "high")

    run.__name__ = f"window_exclude_{exclude.replace(' ', '_')}_of_groups"
    frame = f"(PARTITION BY o_custkey ORDER BY o_orderkey % 4 GROUPS BETWEEN 1 PRECEDING AND 2 FOLLOWING EXCLUDE {exclude.upper()})"
    query(f"SELECT o_orderkey, count(price) OVER w AS n, sum(price) OVER w::BIGINT AS total, min(price) OVER w AS low, max(price) OVER w AS high FROM (SELECT *, round(o_totalprice)::BIGINT AS price FROM orders) WINDOW w AS {frame}")(run)


for _exclude in ("current row", "group", "ties"):
    _groups_query(_exclude)


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS in_day FROM events")
def window_interval_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", "count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS in_day")


@query("SELECT o_orderkey, o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey) AS share FROM orders")
def window_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / F.sum("o_totalprice").over(Window.partitionBy("o_custkey"))).alias("share"))
