"""Joins that Spark has no operator for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.storage import stored


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, values: list[str], strict: bool = True, width: float | None = None) -> DataFrame:
    """Each left row with ``values`` of the latest right row of the same key that is earlier (or
    as early, if not ``strict``); nulls where there is none.

    Both sides are laid over each other and the last right row is carried along: one shuffle, linear
    in the rows, where a join would meet all pairs of a key.  With ``width`` (of numbers, or of
    seconds for times) time lines are cut into bins of a key, each of which starts with the last
    right row of the bins before, so that a common key isn't one task's.  Left rows without a key or a
    time are kept and find nothing; such right rows are never found.
    """
    struct = F.struct(F.col(right_ts).alias("__at"), *values)
    # at equal times a strict join sees the left row first
    lefts = left.select(*[F.col(c) for c in left.columns], F.col(left_ts).alias("__ts"), F.lit(0 if strict else 1).alias("__side"))
    rights = right.dropna(subset=[*by, right_ts]).select(*by, F.col(right_ts).alias("__ts"), F.lit(1 if strict else 0).alias("__side"), struct.alias("__right"))
    both, keys = lefts.unionByName(rights, allowMissingColumns=True), list(by)
    if width is not None:
        both, keys = both.withColumn("__bin", time_bin("__ts", width)), [*by, "__bin"]
        last = rights.withColumn("__bin", time_bin("__ts", width)).groupBy(*keys).agg(F.max_by("__right", "__ts").alias("__last"))
        # one row of a key and bin at most, far fewer than rows
        bins = both.select(*keys).distinct().join(last, keys, "left")
        ahead = bins.withColumn("__carried", F.last("__last", ignorenulls=True).over(Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1))).select(*keys, "__carried")
        both = both.join(ahead, keys, "left")
    w = Window.partitionBy(*keys).orderBy("__ts", "__side").rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("__last", F.last("__right", ignorenulls=True).over(w)).where(F.col("__side") == (0 if strict else 1))
    if width is not None:
        found = found.withColumn("__last", F.coalesce("__last", "__carried"))
    return found.select(*left.columns, F.col("__last.__at").alias(f"{right_ts}_matched"), *(F.col(f"__last.{v}").alias(v) for v in values))


def time_bin(column: str, width: float):
    """The bin of a time (or number) by its seconds."""
    return F.floor(F.unix_micros(F.col(column).cast("timestamp")) / (width * 1e6)).alias("__bin")


def interval_join(left: DataFrame, right: DataFrame, by: str, ts: str, seconds: int) -> DataFrame:
    """Pairs (a, b: structs of the sides' rows) of one key in which b comes after a, by ``seconds``
    at most.  A right row is dealt to its bin of that width and a left one to its own and the next,
    so rows of a key meet only if they are near."""
    own = time_bin(ts, seconds)
    a = left.select(F.col(by).alias("__key"), F.struct("*").alias("a"), F.explode(F.array(own, own + 1)).alias("__bin"))
    b = right.select(F.col(by).alias("__key"), F.struct("*").alias("b"), own.alias("__bin"))
    near = (F.col(f"b.{ts}") > F.col(f"a.{ts}")) & (F.col(f"b.{ts}") <= F.col(f"a.{ts}") + F.make_dt_interval(secs=F.lit(seconds)))
    return a.join(b, ["__key", "__bin"]).where(near).select("a", "b")


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Points within [low, high].  A range is dealt to every bin of ``width`` that it meets and a
    point to its own, so the join is one on equal bins instead of a nested loop."""
    binned = points.withColumn("__bin", F.floor(F.col(point) / width))
    spread = ranges.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return binned.join(spread, "__bin").where(F.col(point).between(F.col(low), F.col(high))).drop("__bin")


def salted_join(large: DataFrame, small: DataFrame, key: str, salts: int = 16, share: float = 0.001) -> DataFrame:
    """An inner join for a skewed ``key`` of ``large``: rows of keys that more than ``share`` of its rows have
    (at most 1 / share keys) are dealt to ``salts`` parts, and their rows of ``small`` are repeated for each part.

    Both sides are shuffled and sorted, as the planner takes the repeated side for as small as ``small`` and would
    broadcast it through the driver."""
    counts = stored(large.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n")), "counts")
    total = F.broadcast(counts.agg(F.sum("__n").alias("__total")))
    hot = stored(counts.crossJoin(total).where(F.col("__n") > share * F.col("__total")).select(key, F.lit(True).alias("__hot")), "hot")
    dealt = large.join(F.broadcast(hot), key, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*large.columns), F.lit(salts)).cast("int")).otherwise(0)).drop("__hot")
    parts = F.sequence(F.lit(0), F.when(F.col("__hot"), salts - 1).otherwise(0))
    repeated = small.join(F.broadcast(hot), key, "left").withColumn("__salt", F.explode(parts)).drop("__hot")
    return dealt.join(repeated.hint("merge"), [key, "__salt"]).drop("__salt")


def asof_nearest(left: DataFrame, right: DataFrame, by: list[str], ts: str, values: list[str], tolerance: int, direction: str = "nearest") -> DataFrame:
    """Each left row with ``values`` of the right row of the same key whose time is nearest, within ``tolerance``
    seconds; ``direction`` "forward" takes the first that isn't earlier, "backward" the last that isn't later.

    Of two equally near the earlier is taken, of several at one time the greatest values.  A right row is dealt to its
    bin of that width and the ones beside it, so only rows that are near meet and nothing is carried along.
    Left rows without a key, a time or a partner are kept with nulls.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    own = time_bin(ts, tolerance)
    rights = right.dropna(subset=[*by, ts]).groupBy(*by, ts).agg(F.max(F.struct(*values)).alias("__values"))
    found = F.struct(F.col(ts).alias("ts"), at.alias("at"), F.col("__values").alias("v"))
    spread = rights.select(*by, F.explode(F.array(own - 1, own, own + 1)).alias("__bin"), at.alias("__at"), F.lit(0).alias("__side"), found.alias("__right"))
    lefts = left.select(*left.columns, own, at.alias("__at"), F.lit(1).alias("__side"))
    both = lefts.unionByName(spread, allowMissingColumns=True)
    w = Window.partitionBy(*by, "__bin").orderBy("__at", "__side")
    back = F.last("__right", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("__right", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    # at an equal time the right row stands before the left one, so only ``back`` sees it
    placed = both.select("*", back.alias("__back"), ahead.alias("__ahead")).where("__side = 1")
    near = lambda side: F.abs(F.col(f"{side}.at") - F.col("__at"))
    fits = lambda side: near(side) <= tolerance * 1_000_000
    b, a = F.when(fits("__back"), F.col("__back")), F.when(fits("__ahead"), F.col("__ahead"))
    chosen = {
        "backward": b,
        "forward": F.when(near("__back") == 0, F.col("__back")).otherwise(a),
        "nearest": F.when(a.isNull() | (near("__back") <= near("__ahead")), b).otherwise(a),
    }[direction]
    picked = placed.select(*left.columns, chosen.alias("__found"))
    return picked.select(*left.columns, F.col("__found.ts").alias(f"{ts}_matched"), *(F.col(f"__found.v.{v}").alias(v) for v in values))
