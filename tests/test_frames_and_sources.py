"""Frames with exclusion, nearest joins, the segment log and the table function, on cases that the tables lack."""

import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lodeframe.functions import udfs
from lodeframe.operators.frames import groups_frame
from lodeframe.operators.joins import asof_nearest
from lodeframe.sources.segments import SegmentReader, manifests, register_segments
from lodeframe.storage import shared_path


@pytest.mark.parametrize("exclude", ["current row", "group", "ties"])
def test_groups_frames(spark, exclude):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", None]), rng.choice([1, 1, 2, 5, 9, None]), rng.choice([None, -3, 4, 7])) for i in range(60)]
    got = groups_frame(spark.createDataFrame(rows, "id long, k string, o int, v long").repartition(3), ["k"], "o", "v", 1, 2, exclude).collect()
    assert len(got) == 60
    for r in got:
        ranks = sorted({(o is not None, o or 0) for _, k, o, _ in rows if k == r["k"]})
        rank = lambda o: ranks.index((o is not None, o or 0))  # noqa: B023, E731
        own = rank(r["o"])
        kept = [v for i, k, o, v in rows if k == r["k"] and own - 1 <= rank(o) <= own + 2 and (i != r["id"] if exclude == "current row" else rank(o) != own or (exclude == "ties" and i == r["id"]))]
        kept = [v for v in kept if v is not None]
        assert (r["n"], r["total"], r["low"], r["high"]) == (len(kept), sum(kept) if kept else None, min(kept, default=None), max(kept, default=None))


@pytest.mark.parametrize("direction", ["nearest", "forward", "backward"])
def test_nearest_joins(spark, direction):
    rng = random.Random(2)
    left = [(i, rng.choice([1, 2, None]), rng.choice([*range(0, 300, 7), None])) for i in range(80)]
    right = [(rng.choice([1, 2, None]), rng.choice([*range(0, 300, 5), None]), rng.randrange(9)) for _ in range(40)]
    times = lambda rows, schema: spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("ts"))
    got = asof_nearest(times(left, "id long, k long, ts long"), times(right, "k long, ts long, v long"), ["k"], "ts", ["v"], 20, direction).select("id", F.unix_seconds("ts_matched"), "v").collect()
    want = []
    for i, k, t in left:
        fits = [(abs(s - t), s, -v) for q, s, v in right if None not in (k, t, q, s) and q == k and abs(s - t) <= 20 and not (direction == "forward" and s < t) and not (direction == "backward" and s > t)]
        want.append((i, min(fits)[1], -min(fits)[2]) if fits else (i, None, None))
    assert sorted(map(tuple, got)) == sorted(want)


def log(spark, rows, commits=1):
    register_segments(spark)
    path = shared_path(spark, "segments")
    for k in range(commits):
        spark.createDataFrame([r for r in rows if r[0] % commits == k], "id long, v string").repartitionByRange(3, "id").write.format("segments").option("path", path).option("key", "id").mode("append").save()
    return path


def read(spark, path):
    return spark.read.format("segments").schema("id long, v string").option("path", path).option("key", "id").load()


def test_the_log_gives_its_rows_back(spark):
    rows = [(i, None if i % 7 == 0 else f"v{i}") for i in range(100)]
    path = log(spark, rows, commits=2)
    assert sorted(map(tuple, read(spark, path).collect())) == rows
    assert len(manifests(path)) == 2 and sum(m["rows"] for commit in manifests(path) for m in commit) == 100
    for condition, keep in (("id >= 20 AND id < 30", lambda i: 20 <= i < 30), ("id = 5", lambda i: i == 5), ("id > 97", lambda i: i > 97), ("id <= 3 AND v IS NOT NULL", lambda i: i <= 3 and i % 7), ("id > 200", lambda i: False), ("id != 4", lambda i: i != 4)):
        assert sorted(map(tuple, read(spark, path).where(condition).collect())) == [r for r in rows if keep(r[0])]


def test_bounds_of_the_key_leave_segments_out(spark):
    from pyspark.sql.datasource import GreaterThan, LessThanOrEqual, StringContains

    reader = SegmentReader(log(spark, [(i, "x") for i in range(90)]), "id")
    assert len(reader.partitions()) == 3
    other = StringContains(("v",), "x")
    assert list(reader.pushFilters([GreaterThan(("id",), 65), other, LessThanOrEqual(("id",), 70)])) == [other]
    assert (reader.low, reader.high, len(reader.partitions())) == (66, 70, 1)


def test_a_failed_write_leaves_nothing(spark):
    path = log(spark, [(1, "a")])
    bad = spark.range(4).select("id", F.when(F.col("id") == 3, F.raise_error(F.lit("no"))).cast("string").alias("v"))
    with pytest.raises(Exception, match="no"):
        bad.write.format("segments").option("path", path).option("key", "id").mode("append").save()
    assert [tuple(r) for r in read(spark, path).collect()] == [(1, "a")]


def test_the_log_as_a_stream_goes_on_where_it_stopped(spark):
    path, checkpoint, out = log(spark, [(i, "x") for i in range(10)], commits=2), shared_path(spark, "checkpoint"), shared_path(spark, "out")
    stream = spark.readStream.format("segments").schema("id long, v string").option("path", path).option("key", "id").load()

    def run():
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["id"] for r in spark.read.parquet(out).collect())

    assert run() == list(range(10))
    assert run() == list(range(10))
    spark.createDataFrame([(50, "y")], "id long, v string").write.format("segments").option("path", path).option("key", "id").mode("append").save()
    assert run() == [*range(10), 50]


def test_the_table_function_checks_its_arguments(spark):
    spark.udtf.register("lf_sessions", udfs.Sessions)
    spark.createDataFrame([("a", 1), ("a", 5), ("b", 2), ("a", 20), (None, 3)], "who string, at long").createOrReplaceTempView("lf_t")
    got = spark.sql("SELECT * FROM lf_sessions(TABLE(lf_t), 'who', 'at', 4)")
    assert got.dtypes == [("who", "string"), ("start", "bigint"), ("n", "bigint")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 1, 2), ("a", 20, 1), ("b", 2, 1), (None, 3, 1)], key=str)
    with pytest.raises(AnalysisException, match="no column"):
        spark.sql("SELECT * FROM lf_sessions(TABLE(lf_t), 'nobody', 'at', 4)").collect()


def test_xml_files_are_bounded(spark):
    from lodeframe.sources.formats import round_trip

    got = round_trip(spark.range(120_000).coalesce(1), "xml")
    assert len(got.inputFiles()) == 3 and got.count() == 120_000
