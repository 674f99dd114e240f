"""Window frames that leave out the current row's peers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("current row", "group", "ties")


def groups_frame(df: DataFrame, by: list[str], order: str, value: str, before: int, after: int, exclude: str) -> DataFrame:
    """``df`` with n, total, low and high of ``value`` (null where nothing is left) over the frame GROUPS BETWEEN
    ``before`` PRECEDING AND ``after`` FOLLOWING EXCLUDE ``exclude``.

    Peers share a dense rank, so the frame is one of ranks.  What lies before the current group and what lies
    after it are frames of their own, whose results are put together: so low and high, which nothing can be
    taken off, need no rows gathered.  Rows with a null key or order value have their own group, as in SQL.
    """
    if exclude not in KINDS:
        raise ValueError(f"exclude is one of {KINDS}")
    ranked = df.withColumn("__g", F.dense_rank().over(Window.partitionBy(*by).orderBy(order)))
    w = Window.partitionBy(*by).orderBy("__g")
    sides = [w.rangeBetween(-before, -1)] * (before > 0) + [w.rangeBetween(1, after)] * (after > 0)
    v = F.col(value)
    if exclude == "current row":  # the peers, but for one of them
        same = Window.partitionBy(*by, "__g").orderBy(F.monotonically_increasing_id())
        ranked = ranked.withColumn("__i", F.row_number().over(same))
        own = Window.partitionBy(*by, "__g").orderBy("__i")
        sides += [own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(1, Window.unboundedFollowing)]
    alone = exclude == "ties"

    def together(merge, parts: list[Column]) -> Column:
        return merge(*parts) if len(parts) > 1 else parts[0]

    counts = [F.count(v).over(s) for s in sides] + [F.when(v.isNotNull(), 1).otherwise(0)] * alone
    n = sum(counts[1:], counts[0])
    sums = [F.coalesce(F.sum(v).over(s), F.lit(0)) for s in sides] + [F.coalesce(v, F.lit(0))] * alone
    low, high = ([f(v).over(s) for s in sides] + [v] * alone for f in (F.min, F.max))
    out = ranked.select("*", n.alias("n"), sum(sums[1:], sums[0]).alias("__sum"), together(F.least, low).alias("low"), together(F.greatest, high).alias("high"))
    return out.select(*df.columns, F.col("n").cast("long").alias("n"), F.when(F.col("n") > 0, F.col("__sum")).alias("total"), "low", "high")
