"""Nearest vectors of a query set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries and rows whose cosines a task holds at once: 16 MB.
QUERIES, ROWS = 1024, 2048


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """The vectors as rows of length one; zeros for missing vectors and those of another width (None: the largest)."""
    lists = column.to_pylist()
    width = max((len(x) for x in lists if x), default=0) if width is None else width
    rows = np.array([x if x and len(x) == width else [0.0] * width for x in lists], np.float64).reshape(len(lists), width)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def best_of(cosine: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest of each row with their names, of equals the least name; only what reaches a row's k-th largest is
    sorted."""
    if cosine.shape[1] > k:
        last = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, -k]
        row, column = np.nonzero(cosine >= last[:, None])
    else:
        row, column = np.divmod(np.arange(cosine.size), max(1, cosine.shape[1]))
    value, name = cosine[row, column], names[row, column]
    order = np.lexsort((name, -value, row))
    row = row[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    order = order[place < k]
    shape = len(cosine), min(k, cosine.shape[1])
    return value[order].reshape(shape), name[order].reshape(shape)


def nearest(queries: DataFrame, rows: DataFrame, k: int, block: int = 8192) -> DataFrame:
    """(a_id, b_id, cosine): for each query the ``k`` rows of the largest cosine, of equals the least id.

    The queries are taken in blocks of about ``block`` vectors, which are broadcast one after the
    other; all rows stream past each block, ``ROWS`` of them past ``QUERIES`` queries at a time, and a task gives
    ``k`` rows a query at most.  ``queries`` and ``rows`` have columns id and vector.
    """
    n_blocks, found = max(1, -(-queries.count() // block)), None
    for b in range(n_blocks):
        part = queries.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b).toArrow()
        sent = queries.sparkSession.sparkContext.broadcast((np.asarray(part.column("id")), _matrix(part.column("vector").combine_chunks())))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, own = sent.value
            parts = [slice(a, a + QUERIES) for a in range(0, len(ids), QUERIES)]
            best = {a: (np.zeros((len(ids[q]), 0)), np.zeros((len(ids[q]), 0), np.int64)) for a, q in enumerate(parts)}
            for batch in batches:
                for start in range(0, batch.num_rows, ROWS):
                    some = batch.slice(start, ROWS)
                    vectors, names = _matrix(some.column("vector"), own.shape[1]).T, np.asarray(some.column("id"))
                    for a, q in enumerate(parts):
                        cosine = np.round(own[q] @ vectors, 9)
                        held, known = best[a]
                        best[a] = best_of(np.hstack([held, cosine]), np.hstack([known, np.broadcast_to(names, cosine.shape)]), k)
            for a, q in enumerate(parts):
                held, known = best[a]
                if held.size:
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[q], held.shape[1])), pa.array(known.ravel()), pa.array(held.ravel())], ["a_id", "b_id", "cosine"])

        own = rows.select("id", "vector").mapInArrow(search, "a_id long, b_id long, cosine double")
        found = own if found is None else found.unionByName(own)
    w = Window.partitionBy("a_id").orderBy(F.desc("cosine"), "b_id")
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")
