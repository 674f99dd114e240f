"""Typed state by key: value, list and map variables with a time to live, and event-time timers.

Each access to typed state is a message between the Python worker and the JVM (some 10 to 40 ms where this was
measured), so these operators suit keys of many rows a batch; ``stateful`` has forms for many small keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

#: State that a key hasn't touched for so long is dropped.
DAY_MS = 24 * 3600 * 1000


class Profile(StatefulProcessor):
    """After each batch that holds a key: its number of events so far, its latest ``keep`` events and how
    often its commonest weekday was met."""

    keep = 3

    def init(self, handle) -> None:
        self.count = handle.getValueState("count", "n long", DAY_MS)
        self.latest = handle.getListState("latest", "at long, event_id long", DAY_MS)
        self.days = handle.getMapState("days", "day int", "n long", DAY_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        n = (self.count.get()[0] if self.count.exists() else 0) + len(frame)
        self.count.update((int(n),))
        latest = list(self.latest.get()) if self.latest.exists() else []
        latest = sorted([tuple(map(int, x)) for x in latest] + list(zip(frame["at"].astype(int).tolist(), frame["event_id"].astype(int).tolist(), strict=True)))[-self.keep :]
        self.latest.put(latest)
        days = {int(k[0]): int(v[0]) for k, v in self.days.iterator()}
        for day, own in frame["day"].value_counts().items():
            days[int(day)] = days.get(int(day), 0) + int(own)
            self.days.updateValue((int(day),), (days[int(day)],))
        yield pd.DataFrame({"event_type": [key[0]], "n": [n], "latest": ["-".join(str(i) for _, i in latest)], "commonest": [max(days.values())]})

    def close(self) -> None:
        pass


def profiles(events: DataFrame) -> DataFrame:
    rows = events.select("event_type", "event_id", F.dayofweek("ts").alias("day"), F.unix_micros("ts").alias("at"))
    return rows.groupBy("event_type").transformWithStateInPandas(Profile(), "event_type string, n long, latest string, commonest long", "Update", "ProcessingTime")


class Silence(StatefulProcessor):
    """Reports a key once the watermark is ``gap_ms`` past its last event: a timer is set for that time and
    moved as further events come."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        at, n = map(int, self.last.get()) if self.last.exists() else (0, 0)
        if self.last.exists():
            self.handle.deleteTimer(self._due(at))
        at, n = max(at, int(frame["at"].max())), n + len(frame)
        self.last.update((at, n))
        self.handle.registerTimer(self._due(at))
        yield pd.DataFrame({"key": pd.Series([], dtype="int64"), "last": pd.Series([], dtype="int64"), "n": pd.Series([], dtype="int64")})

    def _due(self, at: int) -> int:
        return at // 1000 + self.gap_ms

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, n = map(int, self.last.get())
        self.last.clear()
        yield pd.DataFrame({"key": [key[0]], "last": [at], "n": [n]})

    def close(self) -> None:
        pass


def silences(events: DataFrame, key: Column, gap_seconds: int) -> DataFrame:
    """(key, last: microseconds, n): each key's stretch of events that a silence of ``gap_seconds`` ended.
    ``events`` has a watermark; a stretch goes on until the watermark, not an event, shows the gap, so how events are
    split into batches decides what belongs to one."""
    rows = events.select(key.cast("long").alias("key"), "ts", F.unix_micros("ts").alias("at"))
    return rows.groupBy("key").transformWithStateInPandas(Silence(gap_seconds * 1000), "key long, last long, n long", "Append", "EventTime")
