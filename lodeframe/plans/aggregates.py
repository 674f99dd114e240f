"""Aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.functions.statistics import sample_skewness
from lodeframe.operators.ranks import quantiles
from lodeframe.plans.registry import query, table
from lodeframe.storage import stored


@query("SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers, sum(o_totalprice) AS total, avg(o_totalprice) AS mean, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1")
def agg_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"), F.sum(price).alias("total"), F.avg(price).alias("mean"), F.min(price).alias("lo"), F.max(price).alias("hi"))


@query("SELECT count(*) AS n, sum(l_quantity) AS quantity FROM lineitem")
def agg_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("""SELECT c_mktsegment, stddev_samp(c_acctbal) AS sd, stddev_pop(c_acctbal) AS sd_pop, var_samp(c_acctbal) AS var, var_pop(c_acctbal) AS var_pop,
 kurtosis_pop(c_acctbal) AS kurt, skewness(c_acctbal) AS skew FROM customer GROUP BY 1""")
def agg_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = "c_acctbal"
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.stddev_samp(b).alias("sd"), F.stddev_pop(b).alias("sd_pop"), F.var_samp(b).alias("var"), F.var_pop(b).alias("var_pop"), F.kurtosis(b).alias("kurt"), sample_skewness(b).alias("skew"))


@query("""SELECT l_returnflag, corr(l_quantity, l_extendedprice) AS r, covar_samp(l_quantity, l_extendedprice) AS cov, covar_pop(l_quantity, l_extendedprice) AS cov_pop,
 regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem GROUP BY 1""")
def agg_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, p = "l_quantity", "l_extendedprice"
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.corr(q, p).alias("r"), F.covar_samp(q, p).alias("cov"), F.covar_pop(q, p).alias("cov_pop"), F.regr_slope(p, q).alias("slope"), F.regr_intercept(p, q).alias("intercept"), F.regr_r2(p, q).alias("r2"))


@query("SELECT l_returnflag, median(l_quantity) AS med, quantile_cont(l_extendedprice, 0.9) AS p90, quantile_disc(l_quantity, 0.25) AS q25 FROM lineitem GROUP BY 1")
def agg_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three groups: only values near the wanted ranks meet in a task."""
    items = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    return quantiles(items, ["l_returnflag"], {"med": ("l_quantity", 0.5, True), "p90": ("l_extendedprice", 0.9, True), "q25": ("l_quantity", 0.25, False)})


@query("SELECT o_custkey, median(o_totalprice) AS med, quantile_disc(o_totalprice, 0.25) AS q25 FROM orders GROUP BY 1")
def agg_percentiles_of_small_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.median("o_totalprice").alias("med"), F.expr("percentile_disc(0.25) WITHIN GROUP (ORDER BY o_totalprice)").alias("q25"))


@query("SELECT event_type, k AS mode_k FROM (SELECT event_type, k, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, k) AS r FROM (SELECT event_type, (event_id * event_id) % 5 AS k FROM events) GROUP BY 1, 2) WHERE r = 1")
def agg_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent value, of equally frequent ones the least."""
    k = (F.col("event_id") * F.col("event_id")) % 5
    counts = table(spark, sf_dir, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))
    return counts.groupBy("event_type").agg(F.min_by("k", F.struct(-F.col("n"), "k")).alias("mode_k"))


@query("SELECT c_nationkey::BIGINT AS c_nationkey, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS segments FROM customer GROUP BY 1")
def agg_collect_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("c_nationkey")).agg(F.array_join(F.sort_array(F.collect_set("c_mktsegment")), ",").alias("segments"))


@query("SELECT o_custkey, bool_and(o_totalprice > 1000) AS every_one, bool_or(o_totalprice > 300000) AS any_one, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished FROM orders GROUP BY 1")
def agg_bool_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_and(F.col("o_totalprice") > 1000).alias("every_one"), F.bool_or(F.col("o_totalprice") > 300000).alias("any_one"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))


@query("SELECT user_id, arg_max(event_id, ts) AS last_event, arg_min(event_id, ts) AS first_event FROM events GROUP BY 1")
def agg_arg_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", "ts").alias("last_event"), F.min_by("event_id", "ts").alias("first_event"))


@query("SELECT n_regionkey::BIGINT AS n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, list_aggregate(list_sort(list(n_nationkey::BIGINT)), 'string_agg', '-') AS keys FROM nation GROUP BY 1")
def agg_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.array_join(F.transform(F.sort_array(F.collect_list("n_nationkey")), lambda k: k.cast("string")), "-")
    return table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("long").alias("n_regionkey")).agg(F.expr("listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name)").alias("names"), keys.alias("keys"))


@query("SELECT c_nationkey::BIGINT AS c_nationkey, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 5")
def agg_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("c_nationkey")).agg(F.count("*").alias("n")).where("n > 5")


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q, grouping_id(l_returnflag, l_linestatus)::BIGINT AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q"), F.grouping_id().alias("g"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def agg_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def agg_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = [[F.col("o_orderstatus")], [F.col("o_orderpriority")], []]
    return table(spark, sf_dir, "orders").groupingSets(sets, "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT floor(o_totalprice / 25000)::BIGINT AS bin, count(*) AS n FROM orders GROUP BY 1")
def agg_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_totalprice") / 25000).alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT sum(c_acctbal::DECIMAL(12, 2))::DECIMAL(22, 2) AS total FROM customer")
def agg_decimal_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").agg(F.sum(F.col("c_acctbal").cast("decimal(12,2)")).cast("decimal(22,2)").alias("total"))


@query()
def agg_approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HyperLogLog++: no exact counterpart; tests hold it to its error bound."""
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.approx_count_distinct("o_custkey", 0.02).alias("customers"), F.percentile_approx("o_totalprice", 0.5, 10000).alias("med"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT date_trunc('day', ts)) AS days, true AS within FROM events GROUP BY 1")
def agg_mergeable_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sketch of each type and day is stored; the days' sketches are united later, without their rows.  ``within``: the
    estimate is within three standard errors of the exact count."""
    events = table(spark, sf_dir, "events")
    daily = stored(events.groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.hll_sketch_agg("user_id", 12).alias("sketch")), "sketches")
    united = daily.groupBy("event_type").agg(F.count("*").alias("days"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("about"))
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    error = 3 * 1.04 / 2**6  # of 2 ** 12 registers
    return exact.join(united, "event_type").select("event_type", "users", "days", (F.abs(F.col("about") - F.col("users")) <= error * F.col("users") + 1).alias("within"))
