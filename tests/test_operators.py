"""Operators on cases that the tables lack: ties, nulls, repeated rows, empty sides."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeframe.functions.statistics import sample_skewness
from lodeframe.functions.vectors import cosine
from lodeframe.operators.joins import asof_join, range_join, salted_join
from lodeframe.operators.topk import top_k_per_group
from lodeframe.storage import stored

LEFT, RIGHT = "id long, k long, ts long", "k long, ts long, v string"


def brute_asof(left, right, strict):
    out = []
    for i, k, t in left:
        found = [(s, v) for q, s, v in right if k is not None and q == k and (s < t if strict else s <= t)]
        latest = max((s for s, _ in found), default=None)
        out.append((i, latest, {v for s, v in found if s == latest}))
    return out


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 6)), max_size=12), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 6)), max_size=12), st.booleans())
def test_asof_join(spark, left, right, strict):
    left = [(i, k, t) for i, (k, t) in enumerate(left)]
    right = [(k, t, f"v{n}") for n, (k, t) in enumerate(right)]
    got = asof_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["k"], "ts", "ts", ["v"], strict).collect()
    expected = {i: (latest, values) for i, latest, values in brute_asof(left, right, strict)}
    assert len(got) == len(left)
    for r in got:
        latest, values = expected[r["id"]]
        assert r["ts_matched"] == latest and (r["v"] in values if latest is not None else r["v"] is None)


@pytest.mark.parametrize("width", [None, 3.0])
def test_asof_join_without_keys_or_times(spark, width):
    left = spark.createDataFrame([(1, 1, 5), (2, None, 5), (3, 1, None), (4, 2, 9)], LEFT)
    right = spark.createDataFrame([(1, 1, "a"), (None, 1, "b"), (1, None, "c"), (2, None, "d")], RIGHT)
    got = asof_join(left, right, ["k"], "ts", "ts", ["v"], width=width).collect()
    assert sorted((r["id"], r["ts_matched"], r["v"]) for r in got) == [(1, 1, "a"), (2, None, None), (3, None, None), (4, None, None)]


def test_range_join_has_each_pair_once(spark):
    points = spark.createDataFrame([(float(x),) for x in (0, 5, 10, 10, 25)], "x double")
    ranges = spark.createDataFrame([(0.0, 10.0), (5.0, 30.0), (11.0, 12.0)], "lo double, hi double")
    got = sorted(tuple(r) for r in range_join(points, ranges, "x", "lo", "hi", 7.0).collect())
    assert got == sorted((x, a, b) for x in (0.0, 5.0, 10.0, 10.0, 25.0) for a, b in ((0.0, 10.0), (5.0, 30.0), (11.0, 12.0)) if a <= x <= b)


def test_salted_join_equals_plain_join(spark):
    large = spark.range(500).select((F.col("id") % 3).alias("k"), "id").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS k, 9L AS id"))
    small = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c")], "k long, s string")
    assert sorted(map(str, salted_join(large, small, "k").collect())) == sorted(map(str, large.join(small, "k").collect()))


def test_top_k_with_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", None, 3), ("b", None, 4)], "g string, v long, i long")
    got = top_k_per_group(df, ["g"], [F.desc_nulls_last("v"), F.asc("i")], 2).select("i").collect()
    assert sorted(r["i"] for r in got) == [1, 2, 4]


def test_cosine_of_zero_vector_is_null(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [1.0, None]


def test_sample_skewness_of_two_values_is_null(spark):
    assert spark.createDataFrame([(1.0,), (2.0,)], "x double").agg(sample_skewness("x")).first()[0] is None


def test_stored_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "x")], "a long, b string")
    again = stored(df, "test")
    assert again.schema == df.schema and sorted(map(str, again.collect())) == sorted(map(str, df.collect()))
    assert stored(df.limit(0), "test").count() == 0


def test_entry_works(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_salted_join_repeats_hot_keys_only_and_broadcasts_no_repeated_side(spark):
    large = spark.range(6000).selectExpr("IF(id < 3000, 7, id) AS k", "id AS x")
    small = spark.range(4000).selectExpr("id AS k", "id * 2 AS y")
    got = salted_join(large, small, "k")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [k#" in plan and "__salt" in plan.split("SortMergeJoin")[1].split("\n")[0]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, large.join(small, "k").collect()))
