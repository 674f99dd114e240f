"""User-defined functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeframe.functions import udfs
from lodeframe.plans.registry import query, table


@query("SELECT c_custkey, greatest(-100, least(100, c_acctbal))::DOUBLE AS clipped FROM customer")
def udf_pandas_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", udfs.clipped("c_acctbal").alias("clipped"))


@query("SELECT o_orderkey, list_sum(list_transform(string_split(o_orderkey::VARCHAR, ''), lambda d: d::BIGINT))::BIGINT AS digits FROM orders")
def udf_arrow_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", udfs.digit_sum("o_orderkey").alias("digits"))


@query("SELECT c_nationkey::BIGINT AS c_nationkey, max(c_acctbal) - min(c_acctbal) AS spread FROM customer GROUP BY 1")
def udf_pandas_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("c_nationkey")).agg(udfs.spread("c_acctbal").alias("spread"))


@query("SELECT s_suppkey, max(s_acctbal) OVER w - min(s_acctbal) OVER w AS spread FROM supplier WINDOW w AS (PARTITION BY s_nationkey)")
def udf_pandas_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", udfs.spread("s_acctbal").over(Window.partitionBy("s_nationkey")).alias("spread"))


@query("SELECT c_custkey, round(c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_nationkey), 6) AS value FROM customer")
def udf_grouped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.col("c_acctbal").alias("value"))
    return rows.groupBy("c_nationkey").applyInPandas(udfs.scaled_by_group, rows.schema).select("c_custkey", F.round("value", 6).alias("value"))


@query("SELECT n.n_nationkey::BIGINT AS k, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM nation n LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1 HAVING count(c_custkey) + count(s_suppkey) > 0")
def udf_cogrouped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pandas as pd

    def both(key, a, b):
        return pd.DataFrame({"k": [int(key[0])], "customers": [len(a)], "suppliers": [len(b)]})

    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey")
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey")
    return a.groupBy("k").cogroup(b.groupBy("k")).applyInPandas(both, "k long, customers long, suppliers long")


@query("SELECT item_id, list_max(list_transform(string_split(text, ' '), lambda w: length(w)))::BIGINT AS longest FROM benchmark")
def udf_batch_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").mapInPandas(udfs.word_lengths, "item_id long, longest long")


@query("SELECT item_id, w AS word, length(w)::BIGINT AS length FROM (SELECT item_id, unnest(string_split(text, ' ')) AS w FROM benchmark)")
def udf_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.udtf.register("lf_words", udfs.Words)
    table(spark, sf_dir, "benchmark").createOrReplaceTempView("lf_benchmark")
    return spark.sql("SELECT item_id, w.word, w.length FROM lf_benchmark, LATERAL lf_words(text) AS w")


@query("""SELECT user_id, min(at_s) AS start, count(*) AS n FROM (SELECT user_id, at_s, sum(CASE WHEN before IS NULL OR at_s > before + 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY at_s) AS session
 FROM (SELECT user_id, at_s, lag(at_s) OVER (PARTITION BY user_id ORDER BY at_s) AS before FROM (SELECT user_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS at_s FROM events))) GROUP BY user_id, session""")
def udf_table_argument(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function that takes a table, dealt out and ordered by what it says of itself."""
    spark.udtf.register("lf_sessions", udfs.Sessions)
    table(spark, sf_dir, "events").select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("at")).createOrReplaceTempView("lf_times")
    return spark.sql("SELECT * FROM lf_sessions(TABLE(lf_times), 'user_id', 'at', 21600)")
