"""Statistics that differ from Spark's own by definition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_skewness(column: str) -> Column:
    """Skewness adjusted for the sample's size; null for fewer than three values."""
    n = F.count(column).cast("double")
    return F.when(n > 2, F.skewness(column) * F.sqrt(n * (n - 1)) / (n - 2))
