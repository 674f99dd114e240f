"""Sorts, limits, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeframe.operators.topk import top_k_per_group
from lodeframe.plans.registry import query, table


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def sort_top_k_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(20)


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def sort_top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_per_group(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@query("SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment, row_number() OVER (PARTITION BY c_nationkey ORDER BY nullif(c_mktsegment, 'BUILDING') ASC NULLS LAST, c_custkey) AS place FROM customer")
def sort_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers, with their places in their nations' orders, nulls last."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))
    w = Window.partitionBy("c_nationkey").orderBy(F.asc_nulls_last("segment"), "c_custkey")
    return rows.select("c_custkey", "segment", F.row_number().over(w).cast("long").alias("place")).sort(F.asc_nulls_last("segment"), "c_custkey")


def _sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_nationkey").cast("long").alias("k"))
    b = table(spark, sf_dir, "supplier").where("s_acctbal < 1000").select(F.col("s_nationkey").cast("long").alias("k"))
    return a, b


_A, _B = "(SELECT c_nationkey::BIGINT AS k FROM customer WHERE c_acctbal > 0)", "(SELECT s_nationkey::BIGINT AS k FROM supplier WHERE s_acctbal < 1000)"


def _set_query(name: str, keyword: str, combine) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return combine(*_sets(spark, sf_dir))

    run.__name__ = name
    query(f"SELECT k FROM {_A} {keyword} SELECT k FROM {_B}")(run)


_set_query("set_union_all", "UNION ALL", lambda a, b: a.union(b))
_set_query("set_union", "UNION", lambda a, b: a.union(b).distinct())
_set_query("set_intersect", "INTERSECT", lambda a, b: a.intersect(b))
_set_query("set_intersect_all", "INTERSECT ALL", lambda a, b: a.intersectAll(b))
_set_query("set_except", "EXCEPT", lambda a, b: a.subtract(b))
_set_query("set_except_all", "EXCEPT ALL", lambda a, b: a.exceptAll(b))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY md5(text)")
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query("SELECT DISTINCT event_type, user_id FROM events")
def dedup_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_type", "user_id").distinct()
