"""Connected components by large-star / small-star contraction (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014), each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.storage import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes on ``edges`` (a, b); root is the least node of its component."""
    stars = stored(edges.selectExpr("greatest(a, b) AS a", "least(a, b) AS b").where("a > b").distinct(), "links")
    seen = _digest(stars)
    while True:
        stars = stored(_small_star(_large_star(stars)), "stars")
        now = _digest(stars)
        if now == seen:  # each node's only link leads to its component's least node
            return stars.selectExpr("a AS node", "b AS root").unionByName(stars.selectExpr("b AS node", "b AS root").distinct())
        seen = now


def _digest(stars: DataFrame) -> tuple:
    """Number and hash of the links: one row, whatever their number."""
    return tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _joined(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each (u, v) with the least of u and u's neighbours, m; and (at, m) of each u once.  The latter
    is stored, so that the join deals both sides out itself and a u of very many v can be split."""
    least = stored(edges.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u AS at", "least(u, m) AS m"), "least")
    return edges.join(least, F.col("u") == F.col("at")), least


def _large_star(stars: DataFrame) -> DataFrame:
    both = stars.selectExpr("a AS u", "b AS v").unionByName(stars.selectExpr("b AS u", "a AS v"))
    return _joined(both)[0].where("v > u").selectExpr("v AS a", "m AS b").where("a != b").distinct()


def _small_star(stars: DataFrame) -> DataFrame:
    joined, least = _joined(stars.selectExpr("a AS u", "b AS v"))
    return joined.selectExpr("v AS a", "m AS b").unionByName(least.selectExpr("at AS a", "m AS b")).where("a != b").distinct()
