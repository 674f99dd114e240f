"""Scans, sources and sinks as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.plans.registry import query, table
from lodeframe.sources.formats import bucketed, partitioned, round_trip
from lodeframe.sources.segments import register_segments
from lodeframe.storage import shared_path
from lodeframe.streaming.runner import to_table


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_base_price,
 sum(l_extendedprice * (1 - l_discount)) AS sum_disc_price, avg(l_quantity) AS avg_qty, avg(l_discount) AS avg_disc, count(*) AS count_order
 FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def q01_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        table(spark, sf_dir, "lineitem")
        .where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(F.sum("l_quantity").alias("sum_qty"), F.sum("l_extendedprice").alias("sum_base_price"), F.sum(price).alias("sum_disc_price"), F.avg("l_quantity").alias("avg_qty"), F.avg("l_discount").alias("avg_disc"), F.count("*").alias("count_order"))
    )


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 49")
def scan_pushed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter and column list reach the Parquet scan."""
    return table(spark, sf_dir, "lineitem").where("l_quantity > 49").select("l_orderkey", "l_quantity")


def _format_query(fmt: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_trip(table(spark, sf_dir, "customer"), fmt)

    run.__name__ = f"scan_{fmt}"
    return query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")(run)


for _fmt in ("parquet", "orc", "json", "csv", "xml"):
    _format_query(_fmt)


@query("SELECT c_name AS value FROM customer")
def scan_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "customer").select(F.col("c_name").alias("value")), "text")


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def scan_partition_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy partitioned by status; only one partition is read."""
    return partitioned(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), "o_orderstatus").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice", "o_orderstatus")


def _segments(spark: SparkSession, sf_dir: str, commits: int = 1) -> tuple[str, DataFrame]:
    """The events as a log of segments, sorted by id, in so many commits."""
    register_segments(spark)
    events, path = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), shared_path(spark, "segments")
    for k in range(commits):
        own = events.where(F.pmod(F.xxhash64("user_id"), F.lit(commits)) == k)
        own.repartitionByRange(4, "event_id").write.format("segments").option("path", path).option("key", "event_id").mode("append").save()
    return path, events


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_id BETWEEN 100 AND 899 AND event_type = 'click'")
def scan_custom_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source and sink written against the Python data source interface; bounds of its key are pushed into it."""
    path, events = _segments(spark, sf_dir)
    return spark.read.format("segments").schema(events.schema).option("path", path).option("key", "event_id").load().where("event_id >= 100 AND event_id < 900 AND event_type = 'click'")


@query("SELECT event_id, user_id, event_type, value FROM events")
def stream_custom_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log as a stream, whose offsets are its commits."""
    path, events = _segments(spark, sf_dir, commits=3)
    return to_table(spark.readStream.format("segments").schema(events.schema).option("path", path).option("key", "event_id").load(), "append")


@query("SELECT i::BIGINT AS id, count(p_partkey) AS parts FROM range(1, 60) AS r(i) LEFT JOIN part ON p_size = i GROUP BY 1")
def scan_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of numbers beside a table: sizes that no part has are there, too."""
    parts = table(spark, sf_dir, "part").select("p_size", "p_partkey")
    return spark.range(1, 60).join(parts, F.col("p_size") == F.col("id"), "left").groupBy("id").agg(F.count("p_partkey").alias("parts"))


@query("SELECT name, count(*) AS orders FROM orders JOIN (VALUES ('F', 'filled'), ('O', 'open'), ('P', NULL)) AS t(code, name) ON o_orderstatus = code GROUP BY 1")
def scan_inline_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("F", "filled"), ("O", "open"), ("P", None)], "code string, name string")
    return table(spark, sf_dir, "orders").join(F.broadcast(names), F.col("o_orderstatus") == F.col("code")).groupBy("name").agg(F.count("*").alias("orders"))


@query("SELECT count(DISTINCT n_regionkey) AS files, count(*) AS names FROM nation")
def scan_binary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of text files as bytes: one row per file, here one for each region."""
    path = shared_path(spark, "binary")
    table(spark, sf_dir, "nation").select("n_name", "n_regionkey").repartition("n_regionkey").write.partitionBy("n_regionkey").text(path)
    lines = F.size(F.split(F.rtrim(F.col("content").cast("string"), F.lit("\n")), "\n"))
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path).agg(F.count("*").alias("files"), F.sum(lines).alias("names"))


@query("SELECT o_orderstatus, count(*) AS n, sum(l_quantity) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def scan_bucketed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog tables bucketed alike: their join needs no shuffle of either side."""
    o, i = bucketed(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey"), bucketed(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity"), "l_orderkey")
    return o.join(i.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query()
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample of about a tenth of the rows, a sampling operator."""
    return table(spark, sf_dir, "lineitem").sample(fraction=0.1, seed=7)


@query()
def sample_table_clause(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TABLESAMPLE with a seed, a sampling operator."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("sampled_lineitem")
    return spark.sql("SELECT * FROM sampled_lineitem TABLESAMPLE (10 PERCENT) REPEATABLE (7)")


@query()
def sample_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").sampleBy("o_orderstatus", {"F": 0.2, "O": 0.1, "P": 1.0}, seed=7)
