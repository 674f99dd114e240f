"""User-defined functions of every kind, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


@F.pandas_udf(T.DoubleType())
def clipped(values: pd.Series) -> pd.Series:
    return values.clip(lower=-100.0, upper=100.0)


@F.udf(T.LongType(), useArrow=True)
def digit_sum(n: int) -> int:
    return sum(map(int, str(abs(n))))


@F.pandas_udf(T.DoubleType())
def spread(values: pd.Series) -> float:
    """An aggregate: largest less smallest."""
    return float(values.max() - values.min())


def scaled_by_group(frame: pd.DataFrame) -> pd.DataFrame:
    """A grouped map: each value less its group's mean."""
    return frame.assign(value=frame["value"] - frame["value"].mean())


def word_lengths(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A batch map."""
    for frame in frames:
        yield pd.DataFrame({"item_id": frame["item_id"], "longest": frame["text"].str.split(" ").map(lambda w: max(map(len, w))).astype("int64")})


@F.udtf(returnType="word string, length long")
class Words:
    """A table function: a row for each word."""

    def eval(self, text: str) -> Iterator[tuple[str, int]]:
        for word in (text or "").split(" "):
            yield word, len(word)


@F.udtf
class Sessions:
    """A table function of a table: the sessions of each key, its rows in the order of time.

    The schema follows the key column's type, and the partitioning and order are the function's own, so a
    caller can't leave them out.
    """

    def __init__(self):
        self.open = None

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, at: AnalyzeArgument, gap: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not isinstance(rows.dataType, T.StructType):
            raise ValueError("the first argument is a table")
        names = rows.dataType.fieldNames()
        for name in (key.value, at.value):
            if name not in names:
                raise ValueError(f"no column {name}")
        schema = T.StructType([T.StructField(key.value, rows.dataType[key.value].dataType), T.StructField("start", T.LongType()), T.StructField("n", T.LongType())])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn(at.value)])

    def eval(self, row, key: str, at: str, gap: int) -> Iterator[tuple]:
        if self.open and row[at] <= self.open[2] + gap:
            self.open[2:] = [row[at], self.open[3] + 1]
            return
        yield from self._closed()
        self.open = [row[key], row[at], row[at], 1]

    def terminate(self) -> Iterator[tuple]:
        yield from self._closed()

    def _closed(self) -> Iterator[tuple]:
        if self.open:
            yield self.open[0], self.open[1], self.open[3]
