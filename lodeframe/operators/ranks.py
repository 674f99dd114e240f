"""Ranks and quantiles of groups that are too large for a task: only values near a wanted rank, or in the
same bin, meet in one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.storage import stored

#: A bracket's ends are looked up to 1 / ACCURACY of a group's rows, and set so many times as far apart.
ACCURACY, MARGIN = 2_000, 4


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which null keys are equal; the keys of ``left`` stay."""
    other = right.select(*(F.col(c).alias(f"__right_{c}") if c in keys else F.col(c) for c in right.columns))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__right_{c}")) for c in keys))
    return left.join(other, same, how).drop(*(f"__right_{c}" for c in keys))


def quantiles(df: DataFrame, by: list[str], measures: dict[str, tuple[str, float, bool]]) -> DataFrame:
    """(by, a column for each measure): of the values of a measure's column that aren't null, the value at the
    rank p * (n - 1), between its neighbours if continuous, else the first value that at least a share p doesn't
    exceed.  Exact.

    One aggregation brackets all wanted ranks with mergeable summaries.  A second one counts the distinct
    values inside the brackets and, as one row, those below, so what meets in a task is a small
    share of a group, however far apart its values are.  Should a summary ever miss its stated error, the query fails
    instead of giving a wrong value.  A null key is a group; a group without values has null.
    """
    names = list(measures)
    asked = []
    for k, (column, p, _) in enumerate(measures.values()):
        v, off = F.col(column).cast("double"), MARGIN / ACCURACY
        ends = [max(0.0, p - off), min(1.0, p + off)]
        asked += [F.percentile_approx(v, ends, ACCURACY).alias(f"__ends{k}"), F.min(v).alias(f"__low{k}"), F.max(v).alias(f"__high{k}"), F.count(v).alias(f"__n{k}")]
    # stored, as a join on an aggregate of few groups would deal each group's rows to one task, and sort them there
    brackets = stored(df.groupBy(*by).agg(*asked), "brackets")

    def bracket(k: int, column: str, p: float) -> Column:
        # beyond the first and the last looked-up rank the ends are the group's own
        low = F.col(f"__low{k}") if p <= MARGIN / ACCURACY else F.col(f"__ends{k}")[0]
        high = F.col(f"__high{k}") if p >= 1 - MARGIN / ACCURACY else F.col(f"__ends{k}")[1]
        return F.struct(F.lit(k).alias("k"), F.col(column).cast("double").alias("v"), low.alias("low"), high.alias("high"))

    each = null_safe_join(df, brackets, by).select(*by, F.explode(F.array(*(bracket(k, column, p) for k, (column, p, _) in enumerate(measures.values())))).alias("__m"))
    near = each.where("__m.v <= __m.high").groupBy(*by, F.col("__m.k").alias("__k"), F.when(F.col("__m.v") >= F.col("__m.low"), F.col("__m.v")).alias("__v")).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*by, "__k").orderBy(F.col("__v").asc_nulls_first())
    counted = near.withColumn("__end", F.sum("__n").over(w)).where("__v IS NOT NULL")
    wanted = []
    for k, (_, p, continuous) in enumerate(measures.values()):
        n = F.col(f"__n{k}")
        at = F.lit(p) * (n - 1) if continuous else F.greatest(F.lit(0), F.ceil(F.lit(p) * n) - 1)
        wanted.append(F.struct(F.lit(k).alias("k"), at.cast("double").alias("at"), n.alias("total")))
    ranks = brackets.select(*by, F.explode(F.array(*wanted)).alias("__w")).select(*by, F.col("__w.k").alias("__k"), F.col("__w.at").alias("__at"), F.col("__w.total").alias("__total"))
    inside = lambda rank: F.max(F.when((rank < F.col("__end")) & (rank >= F.col("__end") - F.col("__n")), F.col("__v")))
    both = null_safe_join(ranks, counted, [*by, "__k"], "left").groupBy(*by, "__k", "__at", "__total").agg(inside(F.floor("__at")).alias("__a"), inside(F.ceil("__at")).alias("__b"))
    value = F.col("__a") + (F.col("__b") - F.col("__a")) * (F.col("__at") - F.floor("__at"))
    missed = (F.col("__total") > 0) & (F.col("__a").isNull() | F.col("__b").isNull())
    value = F.when(missed, F.raise_error(F.lit("a summary missed its error bound")).cast("double")).otherwise(value)
    done = both.select(*by, "__k", value.alias("__value"))
    return done.groupBy(*by).agg(*(F.max(F.when(F.col("__k") == k, F.col("__value"))).alias(name) for k, name in enumerate(names)))


def counts_in_range(df: DataFrame, by: list[str], value: str, low: Column, high: Column, width: float, name: str) -> DataFrame:
    """Each row with the number of its group's values between ``low`` and ``high`` (inclusive); null where an
    end is null.  A null key is a group; null values aren't counted.

    Rows and the two ends of each row's range are laid over each other in bins of ``width``: an end
    sees how many values come before it in its bin, and the bin how many before the bin.
    """
    # stored, as the number of a row must be the same wherever it is read
    rows = stored(df.withColumn("__row", F.monotonically_increasing_id()), "rows")
    bins = F.floor(F.col("__at") / width).alias("__bin")
    # at equal places: a range's low end, then values, then high ends
    sides = F.array(*(F.struct(x.cast("double").alias("at"), F.lit(side).alias("side")) for side, x in enumerate((low, F.col(value), high))))
    laid = rows.select(*by, "__row", F.explode(sides).alias("__p")).select(*by, "__row", F.col("__p.at").alias("__at"), F.col("__p.side").alias("__side")).where("__at IS NOT NULL").select("*", bins)
    own = F.count(F.when(F.col("__side") == 1, 1))
    n = laid.groupBy(*by, "__bin").agg(own.alias("__n"))
    before = n.withColumn("__before", F.sum("__n").over(Window.partitionBy(*by).orderBy("__bin")) - F.col("__n")).drop("__n")
    seen = laid.withColumn("__seen", own.over(Window.partitionBy(*by, "__bin").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    each = null_safe_join(seen.where("__side != 1"), before, [*by, "__bin"]).withColumn("__c", F.col("__seen") + F.col("__before"))
    found = each.groupBy("__row").agg((F.max(F.when(F.col("__side") == 2, F.col("__c"))) - F.max(F.when(F.col("__side") == 0, F.col("__c")))).alias(name))
    return rows.join(found, "__row", "left").drop("__row")
