"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.plans.registry import query, table


@query("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderpriority LIKE '1%' AND o_orderstatus IN ('F', 'O')")
def filter_between_like_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(F.col("o_totalprice").between(1000, 50000) & F.col("o_orderpriority").like("1%") & F.col("o_orderstatus").isin("F", "O")).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_type ILIKE '%a%' AND NOT p_brand ILIKE '%1'")
def filter_ilike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.col("p_type").ilike("%a%") & ~F.col("p_brand").ilike("%1")).select("p_partkey")


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band,
 coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment, greatest(c_acctbal, 0) AS floor0, least(c_acctbal, 1000) AS cap FROM customer""")
def project_case_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.col("c_acctbal")
    band = F.when(balance < 0, "debt").when(balance < 5000, "low").otherwise("high")
    return table(spark, sf_dir, "customer").select("c_custkey", band.alias("band"), F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("none")).alias("segment"), F.greatest(balance, F.lit(0.0)).alias("floor0"), F.least(balance, F.lit(1000.0)).alias("cap"))


@query("SELECT c_custkey, (nullif(c_nationkey, 3) IS DISTINCT FROM 5) AS differs FROM customer")
def filter_distinct_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", (~F.nullif("c_nationkey", F.lit(3)).eqNullSafe(F.lit(5))).alias("differs"))


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
def filter_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").where("o_totalprice > 300000")
    return table(spark, sf_dir, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT CASE WHEN n_regionkey = 1 THEN NULL ELSE n_nationkey END FROM nation)")
def filter_not_in_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOT IN over a list that holds a null gives no rows."""
    table(spark, sf_dir, "customer").createOrReplaceTempView("lf_customer")
    table(spark, sf_dir, "nation").createOrReplaceTempView("lf_nation")
    return spark.sql("SELECT c_custkey FROM lf_customer WHERE c_nationkey NOT IN (SELECT CASE WHEN n_regionkey = 1 THEN NULL ELSE n_nationkey END FROM lf_nation)")


@query("SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def filter_correlated_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("lf_orders")
    return spark.sql("SELECT o_orderkey, o_totalprice FROM lf_orders o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM lf_orders i WHERE i.o_custkey = o.o_custkey)")


@query("SELECT n_name, o.o_orderkey FROM nation, LATERAL (SELECT o_orderkey FROM orders WHERE o_orderkey % 25 = n_nationkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) AS o")
def subquery_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order's columns are selected inside: Spark 4.1 turns the limit into ranks by nation, and forgets an order
    by columns that the subquery doesn't give."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("lf_orders")
    table(spark, sf_dir, "nation").createOrReplaceTempView("lf_nation")
    return spark.sql("SELECT n_name, o.o_orderkey FROM lf_nation, LATERAL (SELECT o_orderkey, o_totalprice FROM lf_orders WHERE o_orderkey % 25 = n_nationkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) AS o")


@query("SELECT p_partkey, TRY_CAST(substr(p_brand, 7) AS INTEGER)::BIGINT AS brand_no, TRY_CAST(p_type AS INTEGER)::BIGINT AS none FROM part")
def project_try_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.substring("p_brand", 7, 100).try_cast("int").cast("long").alias("brand_no"), F.col("p_type").try_cast("int").cast("long").alias("none"))


_TRIP = """WITH RECURSIVE next AS (SELECT n_nationkey AS k, n_regionkey AS r, n_name AS name, lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS following, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS place FROM {nation}),
 trip(k, r, following, path, hops) AS (SELECT k, r, following, name, 1 FROM next WHERE place = 1 UNION ALL SELECT n.k, n.r, n.following, concat(path, '>', n.name), hops + 1 FROM trip t JOIN next n ON n.k = t.following)
 SELECT CAST(k AS BIGINT) AS k, CAST(r AS BIGINT) AS r, path, CAST(hops AS BIGINT) AS hops FROM trip"""


@query(_TRIP.format(nation="nation"))
def recursive_cte(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trip through each region's nations, one more with each step."""
    table(spark, sf_dir, "nation").createOrReplaceTempView("lf_nation_trip")
    return spark.sql(_TRIP.format(nation="lf_nation_trip"))


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def reshape_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values are named, so that no job has to find them first."""
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)


@query("SELECT s_suppkey, k AS measure, v AS value FROM (SELECT s_suppkey, unnest(['nation', 'balance']) AS k, unnest([s_nationkey::DOUBLE, s_acctbal]) AS v FROM supplier)")
def reshape_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("nation"), F.col("s_acctbal").alias("balance"))
    return wide.unpivot("s_suppkey", ["nation", "balance"], "measure", "value")
