"""Joins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.operators.joins import asof_join, asof_nearest, interval_join, range_join, salted_join
from lodeframe.plans.registry import query, table
from lodeframe.sources.formats import partitioned


@query("SELECT c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 200000")
def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").where("o_totalprice > 200000")
    return table(spark, sf_dir, "customer").join(large, F.col("c_custkey") == F.col("o_custkey")).select("c_name", "o_orderkey", "o_totalprice")


def _outer(how: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a = table(spark, sf_dir, "customer").where("c_nationkey < 12").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
        b = table(spark, sf_dir, "supplier").where("s_nationkey > 6").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
        return a.join(b, F.col("c_nationkey") == F.col("s_nationkey"), how).select(F.col("c_nationkey").cast("long").alias("c_nationkey"), "customers", F.col("s_nationkey").cast("long").alias("s_nationkey"), "suppliers")

    run.__name__ = f"join_{how}"
    return query(f"""SELECT c_nationkey::BIGINT AS c_nationkey, customers, s_nationkey::BIGINT AS s_nationkey, suppliers
 FROM (SELECT c_nationkey, count(*) AS customers FROM customer WHERE c_nationkey < 12 GROUP BY 1) a
 {how.upper()} JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier WHERE s_nationkey > 6 GROUP BY 1) b ON c_nationkey = s_nationkey""")(run)


for _how in ("left", "right", "full"):
    _outer(_how)


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def join_left_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").join(table(spark, sf_dir, "lineitem").where("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def join_left_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of fixed size."""
    return table(spark, sf_dir, "region").select("r_name").crossJoin(table(spark, sf_dir, "nation").select("n_name"))


@query("SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey")
def join_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (table(spark, sf_dir, "nation").alias(x) for x in "ab")
    return a.join(b, F.expr("a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey")).select(F.col("a.n_name").alias("a_name"), F.col("b.n_name").alias("b_name"))


@query("""SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR""")
def join_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return interval_join(events, events, "user_id", "ts", 3600).select(F.col("a.event_id").alias("a_id"), F.col("b.event_id").alias("b_id"))


@query("""SELECT a.event_id, a.user_id, b.ts AS ts_matched, b.value FROM (SELECT * FROM events WHERE event_type = 'purchase') a
 ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') b ON a.user_id = b.user_id AND a.ts > b.ts""")
def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    left = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return asof_join(left, events.where("event_type = 'click'"), ["user_id"], "ts", "ts", ["value"], width=86_400).select("event_id", "user_id", "ts_matched", "value")


@query("SELECT p_partkey, lo, p_retailprice FROM part JOIN (SELECT (i * 100)::DOUBLE AS lo, (i * 100 + 130)::DOUBLE AS hi FROM range(0, 30) AS r(i)) ON p_retailprice BETWEEN lo AND hi")
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.range(30).select((F.col("id") * 100).cast("double").alias("lo"), (F.col("id") * 100 + 130).cast("double").alias("hi"))
    return range_join(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), bands, "p_retailprice", "lo", "hi", 100.0).select("p_partkey", "lo", "p_retailprice")


@query("SELECT user_id, count(*) AS n FROM events JOIN customer ON user_id = c_custkey GROUP BY user_id")
def join_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return salted_join(table(spark, sf_dir, "events").select("event_id", "user_id"), people, "user_id").groupBy("user_id").agg(F.count("*").alias("n"))


@query("""SELECT n_name, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
 JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 WHERE r_name = 'ASIA' GROUP BY n_name""")
def join_local_supplier_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six tables; nation and region have a fixed size and are broadcast."""
    t = {n: table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem", "supplier", "nation", "region")}
    asia = F.broadcast(t["nation"].join(F.broadcast(t["region"].where("r_name = 'ASIA'")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name"))
    suppliers = t["supplier"].join(asia, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    buyers = t["customer"].join(t["orders"], F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_nationkey")
    sold = t["lineitem"].join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(buyers, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return sold.groupBy("n_name").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))


_PER_STATUS = "SELECT o_orderstatus, c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"


def _orders_of_customers(spark: SparkSession, sf_dir: str, hint: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").hint(hint)
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    return orders.join(people, F.col("o_custkey") == F.col("c_custkey")).groupBy("o_orderstatus", "c_mktsegment").agg(F.count("*").alias("n"))


@query(_PER_STATUS)
def join_by_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides sorted: for sides of any size, as it spills."""
    return _orders_of_customers(spark, sf_dir, "merge")


@query(_PER_STATUS)
def join_by_shuffled_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smaller side hashed in each partition, without a sort: for a side whose shuffle partitions fit
    in memory."""
    return _orders_of_customers(spark, sf_dir, "shuffle_hash")


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def join_by_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of fixed size goes to all tasks, so the other side isn't shuffled."""
    nations = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    return table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


def _near_query(direction: str, condition: str, order: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = table(spark, sf_dir, "events")
        left = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
        return asof_nearest(left, events.where("event_type = 'click'"), ["user_id"], "ts", ["value"], 86_400, direction).select("event_id", "ts_matched", "value")

    run.__name__ = f"join_asof_{direction}"
    query(f"""SELECT event_id, ts_matched, value FROM (SELECT a.event_id, b.ts AS ts_matched, b.value, row_number() OVER (PARTITION BY a.event_id ORDER BY {order}, b.value DESC) AS r
 FROM (SELECT * FROM events WHERE event_type = 'purchase') a LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') b ON a.user_id = b.user_id AND {condition}) WHERE r = 1""")(run)


_near_query("nearest", "abs(epoch_us(b.ts) - epoch_us(a.ts)) <= 86400000000", "abs(epoch_us(b.ts) - epoch_us(a.ts)), b.ts")
_near_query("forward", "b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 DAY", "b.ts")


_FOUR_TABLES = """SELECT o_orderkey, count(*) AS items, sum(l_quantity) AS quantity FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
 WHERE n_name = 'NATION_3' GROUP BY 1"""
_KEYS = {"lineitem": ["l_orderkey", "l_quantity"], "orders": ["o_orderkey", "o_custkey"], "customer": ["c_custkey", "c_nationkey"], "nation": ["n_nationkey", "n_name"]}


@query(_FOUR_TABLES.format(**{name: name for name in _KEYS}))
def join_ordered_by_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written from the largest table to the smallest; column statistics let the optimizer begin with the nation.  The settings are
    those of a session of its own."""
    own = spark.newSession()
    own.conf.set("spark.sql.cbo.enabled", "true")
    own.conf.set("spark.sql.cbo.joinReorder.enabled", "true")
    names = {name: f"analyzed_{name}_{uuid.uuid4().hex}" for name in _KEYS}
    for name, columns in _KEYS.items():
        table(own, sf_dir, name).select(*columns).write.saveAsTable(names[name])
        own.sql(f"ANALYZE TABLE {names[name]} COMPUTE STATISTICS FOR COLUMNS {', '.join(columns)}")
    return own.sql(_FOUR_TABLES.format(**names))


@query("SELECT n_name, count(*) AS customers, sum(c_acctbal) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 GROUP BY 1")
def join_prunes_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers laid out by nation: only the partitions of the nations that the other side's filter keeps are read."""
    people = partitioned(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), "c_nationkey")
    nations = table(spark, sf_dir, "nation").where("n_regionkey = 2").select("n_nationkey", "n_name")
    return people.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("customers"), F.sum("c_acctbal").alias("balance"))
