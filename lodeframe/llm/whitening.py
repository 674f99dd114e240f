"""Embedding whitening by a tiled covariance.

An entry c counts as the whole number x = floor(64 * c) + 1000000 (``scale``, ``shift``), so that sums are
exact.  Dimensions are dealt into column blocks of ``TILE``; a pair of column blocks is a tile of
the covariance.  Each task cuts its vectors into row blocks and each row block into column blocks, which hold
x less the shift in the smallest integers that do.  Column blocks are shuffled by row block, centred
by the exact means where they meet, multiplied tile by tile, and summed per tile and cell with partial
sums on the map side, so no tile's key gets more than a row per cell and task.  What reaches the driver is
the covariance, whose size depends on the number of dimensions only (``MOST`` at most); its
eigenvectors are sent to all tasks (the same bound), which project their rows without a shuffle.

``identity_error`` comes from the covariance of all projected rows, gathered likewise.

Cases: rows whose vector is null, empty, or holds a null, NaN or infinite entry are dropped; so are
vectors of another length than the commonest (of lengths equally common: the longest); 64 * c counts as
2 ** 40 at most in size; components without variance (an eigenvalue below the rounding error of the
largest) are not returned, so a single vector or equal vectors give no rows; ``deviation`` is null where it
exceeds a long; repeated rows and rows without an id are rows like any other; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Dimensions of a column block, rows and bytes of a row block, and dimensions at most.
TILE, ROWS, ROW_BYTES, MOST = 32, 1 << 14, 1 << 25, 8192
#: 64 * c counts as this at most.
LARGEST = float(1 << 40)
COLUMNS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows whose vector is usable, entries as doubles."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0)).where(fine)


def matrix(batch: pa.RecordBatch, d: int, scale: float) -> np.ndarray:
    """floor(scale * c) of a batch's vectors, a row each."""
    flat = np.asarray(batch.column("v").flatten(), dtype=np.float64).reshape(batch.num_rows, d)
    return np.clip(np.floor(scale * flat), -LARGEST, LARGEST).astype(np.int64)


def smallest(values: np.ndarray) -> np.ndarray:
    """The values in the smallest integers that hold them."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    return values.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def centred(y: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """y - sums / n, rounded once: (n * y - sums) is exact where it fits a long."""
    if n * (int(np.abs(y).max(initial=0)) + 1) < 1 << 62:
        return (n * y.astype(np.int64) - np.array(sums, np.int64)) / n
    return y - np.array([s / n for s in sums])


def deviations(y: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The exact sum over the dimensions of (n * y - sums) ** 2; None beyond a long."""
    about = (np.square((y - np.array([s / n for s in sums])) * n)).sum(axis=1)
    out: list[int | None] = [None] * len(y)
    sure = about < 2.0**62  # then no part of it leaves a long
    if sure.any() and n * (int(np.abs(y[sure]).max(initial=0)) + 1) < 1 << 62:
        for k, x in zip(np.flatnonzero(sure).tolist(), np.square(n * y[sure] - np.array(sums, np.int64)).sum(axis=1).tolist(), strict=True):
            out[k] = x
    else:
        sure[:] = False
    for k in np.flatnonzero(~sure & (about < 2.0**64)).tolist():
        exact = sum((n * a - s) ** 2 for a, s in zip(y[k].tolist(), sums, strict=True))
        out[k] = exact if exact < 1 << 63 else None
    return out


def sums_of(fit: DataFrame, d: int, scale: float) -> list[int]:
    """The exact sum of floor(scale * c) in each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for batch in batches:
            for k, part in enumerate(matrix(batch, d, scale).sum(axis=0).tolist()):
                total[k] += part
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], ["dimension", "part"])

    found = fit.mapInArrow(add, "dimension int, part decimal(38,0)").groupBy("dimension").agg(F.sum("part").alias("total")).collect()
    return [int(r["total"]) for r in sorted(found)]


def covariance(fit: DataFrame, d: int, n: int, sums: list[int], scale: float, tile: int = TILE, rows: int = ROWS) -> np.ndarray:
    """The covariance matrix, divisor n, by tiles."""
    rows = max(1, min(rows, ROW_BYTES // d))
    edges = list(range(0, d, tile))

    def column_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            y = matrix(batch, d, scale)
            for a in range(0, len(y), rows):
                held.append(y[a : a + rows])
                size += len(held[-1])
                if size >= rows:
                    yield cut(block, np.concatenate(held))
                    block, held, size = block + 1, [], 0
        if held:
            yield cut(block, np.concatenate(held))

    def cut(block: int, y: np.ndarray) -> pa.RecordBatch:
        parts = [smallest(y[:, e : e + tile]) for e in edges]
        columns = {"row_block": pa.array([block] * len(edges)), "column_block": pa.array(range(len(edges)), pa.int32()), "kind": [p.dtype.str for p in parts], "entries": pa.array([p.tobytes() for p in parts], pa.binary())}
        return pa.RecordBatch.from_pydict(columns)

    def multiply(table: pa.Table) -> pa.Table:
        blocks = {}
        for k, kind, entries in zip(*(table.column(c).to_pylist() for c in ("column_block", "kind", "entries")), strict=True):
            own = sums[edges[k] : edges[k] + tile]
            blocks[k] = centred(np.frombuffer(entries, kind).reshape(-1, len(own)), n, own)
        made = []
        for i in range(len(edges)):
            for j in range(i + 1):
                cells = (blocks[i].T @ blocks[j]).ravel()
                made.append(pa.table({"i": pa.array(np.full(len(cells), i, np.int32)), "j": pa.array(np.full(len(cells), j, np.int32)), "cell": pa.array(np.arange(len(cells), dtype=np.int32)), "part": pa.array(cells)}))
        return pa.concat_tables(made)

    blocks = fit.select("v").mapInArrow(column_blocks, "row_block long, column_block int, kind string, entries binary")
    cells = blocks.groupBy("row_block").applyInArrow(multiply, "i int, j int, cell int, part double").groupBy("i", "j", "cell").agg(F.sum("part").alias("part")).toArrow()
    out = np.zeros((d, d))
    i, j, cell, part = (np.asarray(cells.column(c)) for c in ("i", "j", "cell", "part"))
    width = np.minimum(tile, d - j * tile)
    row, column = i * tile + cell // width, j * tile + cell % width
    out[row, column] = part / n
    out[column, row] = part / n
    return out


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues that aren't rounding errors and their unit eigenvectors, as columns; of either sign, the
    one whose entry of largest size is positive."""
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > max(values.max(initial=0), 0) * len(values) * np.finfo(float).eps]
    vectors = vectors[:, order]
    largest = np.abs(vectors).argmax(axis=0)
    return values[order], vectors * np.where(vectors[largest, np.arange(len(order))] < 0, -1.0, 1.0)


def whiten(rows: DataFrame, n_components: int = 32, scale: float = 64.0, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable vector and component: vec_id, component (from 1), n, deviation, whitened, explained,
    identity_error.  ``shift`` moves all numbers alike and so changes none of these."""
    spark = rows.sparkSession
    usable = vectors(rows, id_col, vector_col)
    lengths = usable.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], COLUMNS)
    d, n = lengths["d"], lengths["n"]
    if d > MOST:
        raise ValueError(f"vectors of {d} dimensions; the driver holds the covariance of {MOST} at most")
    fit = usable.where(F.size("v") == d)
    sums = sums_of(fit, d, scale)
    v = covariance(fit, d, n, sums, scale)
    values, vectors_ = components(v, n_components)
    k = len(values)
    if not k:
        return spark.createDataFrame([], COLUMNS)
    trace = float(np.trace(v))
    sent = spark.sparkContext.broadcast(vectors_ / np.sqrt(values))  # d * n_components doubles

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = matrix(batch, d, scale)
            whitened = np.ascontiguousarray(centred(y, n, sums) @ sent.value)
            held = pa.ListArray.from_arrays(pa.array(np.arange(0, whitened.size + 1, k, dtype=np.int32)), pa.array(whitened.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(deviations(y, n, sums), pa.int64()), held], ["vec_id", "deviation", "whitened"])

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = centred(matrix(batch, d, scale), n, sums) @ sent.value
            total += w.sum(axis=0)
            products += w.T @ w
        cells = np.concatenate([total, products.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], ["cell", "part"])

    gathered = fit.select("v").mapInArrow(moments, "cell int, part double").groupBy("cell").agg(F.sum("part").alias("part")).toArrow()
    cells = np.zeros(k + k * k)
    cells[np.asarray(gathered.column("cell"))] = np.asarray(gathered.column("part"))
    mean = cells[:k] / n
    error = float(np.abs(cells[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    explained = F.array(*(F.lit(float(e / trace)) for e in values))
    each = fit.mapInArrow(project, "vec_id long, deviation long, whitened array<double>")
    named = each.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return named.select("vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.element_at(explained, F.col("place") + 1).alias("explained"), F.lit(error).alias("identity_error"))
