"""Quantiles, range counts and nearest vectors on nulls, outliers and many rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeframe.operators.nearest import best_of, nearest
from lodeframe.operators.ranks import counts_in_range, quantiles


@pytest.mark.parametrize("p", [0.0, 0.001, 0.25, 0.5, 0.9, 1.0])
def test_quantiles(spark, p):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.gauss(0, 1), float(rng.randrange(5)), None])) for _ in range(9000)]
    rows += [("a", 1e300), ("a", -1e300), ("only nulls", None), ("only nulls", None), ("one", 2.5)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r["k"]: r for r in quantiles(df, ["k"], {"c": ("v", p, True), "d": ("v", p, False)}).collect()}
    assert set(got) == {k for k, _ in rows}
    for k in got:
        values = sorted(v for q, v in rows if q == k and v is not None)
        if not values:
            assert got[k]["c"] is None and got[k]["d"] is None
            continue
        assert got[k]["c"] == pytest.approx(float(np.quantile(values, p)))
        assert got[k]["d"] == values[max(0, int(np.ceil(p * len(values))) - 1)]


def test_quantiles_without_rows(spark):
    assert quantiles(spark.createDataFrame([], "k string, v double"), ["k"], {"m": ("v", 0.5, True)}).count() == 0


def test_counts_in_range_keep_rows_without_key_or_value(spark):
    rows = [(1, "a", 1.0), (2, "a", 1.5), (3, "a", 9.0), (4, None, 1.0), (5, None, 2.0), (6, "a", None), (7, "a", 1.0), (7, "a", 1.0)]
    df = spark.createDataFrame(rows, "id long, k string, v double")
    v = F.col("v")
    got = counts_in_range(df, ["k"], "v", v - 1, v + 1, 1.0, "n").collect()
    assert sorted((r["id"], r["n"]) for r in got if r["id"] != 6) == [(1, 4), (2, 4), (3, 1), (4, 2), (5, 2), (7, 4), (7, 4)]
    assert [r["n"] for r in got if r["id"] == 6] == [None]


def test_best_of_breaks_ties_by_name():
    rng = np.random.default_rng(2)
    cosine, names = rng.integers(0, 4, (30, 50)) / 4, np.array([rng.permutation(50) for _ in range(30)])
    for k in (1, 7, 50, 80):
        value, name = best_of(cosine, names, k)
        for x in range(30):
            want = sorted(zip(-cosine[x], names[x], strict=True))[:k]
            assert list(zip(-value[x], name[x], strict=True)) == want


def test_nearest_in_several_blocks(spark, monkeypatch):
    from lodeframe.operators import nearest as module

    monkeypatch.setattr(module, "QUERIES", 3)
    monkeypatch.setattr(module, "ROWS", 5)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(60, 4)).round(1)
    vectors[7] = 0
    vectors[8:12] = vectors[8]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(90, None)], "id long, vector array<double>").repartition(3)
    got = sorted(tuple(r) for r in nearest(rows.where("id % 5 = 0"), rows, 6, block=4).collect())
    norms = np.linalg.norm(vectors, axis=1)
    unit = np.divide(vectors, norms[:, None], out=np.zeros_like(vectors), where=norms[:, None] > 0)
    unit = np.vstack([unit, np.zeros(4)])
    want = []
    for q in [*range(0, 60, 5), 60]:
        near = sorted((-round(float(unit[q] @ unit[i]), 9), i if i < 60 else 90) for i in range(61))[:6]
        want += [(q if q < 60 else 90, i, -c) for c, i in near]
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in sorted(want)]


def test_many_queries_hold_little(spark):
    import resource

    rng = np.random.default_rng(4)
    cosines = rng.normal(size=(1024, 2048))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for _ in range(5):
        best_of(cosines, np.broadcast_to(np.arange(2048), cosines.shape), 10)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000  # KB


def test_quantiles_of_few_groups_are_not_dealt_by_group(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        df = spark.range(100_000).selectExpr("id % 3 AS k", "cast(id * 7919 % 100003 AS double) AS v")
        got = quantiles(df, ["k"], {"m": ("v", 0.5, False)})
        plan = got._jdf.queryExecution().executedPlan().toString()
        found = {r["k"]: r["m"] for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # the rows themselves meet the brackets where they are
    assert not re.search(r"hashpartitioning\(coalesce\(k#\w+, 0\), isnull\(k#\w+\), 4\)", plan)
    values = {k: sorted(float(i * 7919 % 100003) for i in range(k, 100_000, 3)) for k in range(3)}
    assert found == {k: v[(len(v) + 1) // 2 - 1] for k, v in values.items()}
