"""Texts in Arrow batches as bytes.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  These are exactly the bytes
on which ``bytes.split()`` splits, and ``bytes.lower()`` lower-cases exactly A-Z, so both work
on UTF-8 without decoding.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (as long) and the text (null: empty); whatever else ``docs`` has stays unread."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null: empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def sliced(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds ``limit`` bytes of text at most, or a single row."""
    for batch in batches:
        sizes = np.cumsum(np.asarray(batch.column(column).cast(pa.binary()).fill_null(b"").to_pandas().map(len), dtype=np.int64))
        start, n, done = 0, batch.num_rows, 0
        while start < n:
            end = max(start + 1, int(np.searchsorted(sizes, done + limit, side="right")))
            yield batch.slice(start, end - start)
            done, start = int(sizes[end - 1]), end


def sums_by(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values[offsets[i]:offsets[i + 1]]``, 0 for empty ranges."""
    out = np.zeros(len(offsets) - 1, dtype=values.dtype)
    full = offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, offsets[:-1][full])
    return out
