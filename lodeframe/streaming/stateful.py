"""Custom state per key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_totals(events: DataFrame, key: str = "user_id", value: str = "value") -> DataFrame:
    """After each batch, the totals so far of the keys that the batch holds."""

    def update(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for frame in frames:
            n, total = n + len(frame), total + float(frame[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [keys[0]], "n": [n], "total": [total]})

    return events.groupBy(key).applyInPandasWithState(update, f"{key} long, n long, total double", "n long, total double", "append", GroupStateTimeout.NoTimeout)


def sessions_by_timers(events: DataFrame, gap_seconds: int, key: str = "user_id", ts: str = "ts", buckets: int = 1024) -> DataFrame:
    """A key's sessions (key, start and last in microseconds, n), each given once the watermark has
    passed its last event by the gap: state holds open sessions only, a timer wakes those of keys
    that fell silent, and rows behind the watermark are dropped.  ``events`` has a watermark.

    Keys (longs; null is one) share ``buckets`` groups of state, as a call for each key and batch takes longer than the
    work: a call sorts all rows of its bucket.  A batch's rows over ``buckets`` should fit in memory some times."""
    gap = gap_seconds * 1_000_000

    def update(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        behind = state.getCurrentWatermarkMs() * 1000
        held = [np.array(list(map(list, state.get)), np.int64)] if state.exists else []
        if not state.hasTimedOut:
            for frame in frames:
                at = frame["at"].to_numpy(np.int64)
                held.append(np.stack([frame[key].to_numpy(np.int64), at, at, np.ones_like(at)])[:, at > behind])
        own, start, last, n = merged_sessions(np.concatenate(held, axis=1), gap)
        still = last + gap > behind
        if still.any():
            state.update(tuple(x[still].tolist() for x in (own, start, last, n)))
            # a timer must lie ahead of the watermark
            state.setTimeoutTimestamp(max(behind, int(last[still].min()) + gap) // 1000 + 1)
        elif state.exists:
            state.remove()
        if not still.all():
            closed = pd.DataFrame({key: own, "start": start, "last": last, "n": n})[~still]
            yield closed.assign(**{key: pd.Series([None] * len(closed), closed.index, "Int64")}) if keys[1] else closed

    rows = events.select(F.coalesce(key, F.lit(0)).cast("long").alias(key), ts, F.unix_micros(ts).alias("at"), F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), F.col(key).isNull().alias("absent")).where("at IS NOT NULL")
    return rows.groupBy("bucket", "absent").applyInPandasWithState(update, f"{key} long, start long, last long, n long", "keys array<long>, starts array<long>, lasts array<long>, counts array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def merged_sessions(held: np.ndarray, gap: int) -> np.ndarray:
    """Sessions (rows: key, start, last, n) of which those of a key that are ``gap`` apart at most are one."""
    if not held.shape[1]:
        return held
    key, start, last, n = held[:, np.lexsort((held[1], held[0]))]
    other = np.append(True, key[1:] != key[:-1])
    # the latest end so far of each key, by the ends' ranks, which can't overflow
    ends = np.sort(last)
    base = np.cumsum(other) * len(key)
    latest = ends[np.maximum.accumulate(base + np.searchsorted(ends, last)) - base]
    first = np.flatnonzero(other | np.append(True, start[1:] > latest[:-1] + gap))
    return np.stack([key[first], start[first], latest[np.append(first[1:], len(key)) - 1], np.add.reduceat(n, first)])
