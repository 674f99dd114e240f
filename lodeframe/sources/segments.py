"""A log of Arrow segments through Spark's Python data source interface: batch and streaming readers and a writer.

A task writes a segment under a name of its own; the commit lists the finished segments, with the range of their
``key`` column, in a manifest.  Readers know only what a manifest lists, so a task that ran twice or a write that
failed leaves nothing to be read.  A filter on the key leaves out segments by their range and rows by their
value.  As a stream, the log's manifests are its offsets.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int
    low: int | None
    high: int | None


class Segment(InputPartition):
    def __init__(self, path: str, low: int | None = None, high: int | None = None):
        self.path, self.low, self.high = path, low, high


def manifests(path: str) -> list[list[dict]]:
    """What each commit listed, in the commits' order."""
    fs, root = pafs.FileSystem.from_uri(path)
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    names = sorted(f.path for f in found if f.base_name.endswith(".json"))
    return [json.loads(fs.open_input_file(name).read()) for name in names]


class SegmentWriter(DataSourceArrowWriter):
    def __init__(self, path: str, key: str):
        self.path, self.key = path, key

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        name, rows, low, high, out = f"{uuid.uuid4().hex}.arrow", 0, None, None, None
        with fs.open_output_stream(f"{root}/{name}") as sink:
            for batch in iterator:
                out = out or pa.ipc.new_stream(sink, batch.schema)
                out.write_batch(batch)
                keys = batch.column(self.key).drop_null()
                if len(keys):
                    own = pc.min_max(keys).as_py()
                    low, high = min(x for x in (low, own["min"]) if x is not None), max(x for x in (high, own["max"]) if x is not None)
                rows += batch.num_rows
            if out:
                out.close()
        return Written(name, rows, low, high)

    def commit(self, messages: list[Written | None]) -> None:
        listed = [vars(m) for m in messages if m is not None and m.rows]
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        number = len(manifests(self.path))
        with fs.open_output_stream(f"{root}/.{number:08d}") as out:
            out.write(json.dumps(listed).encode())
        fs.move(f"{root}/.{number:08d}", f"{root}/{number:08d}.json")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{root}/{m.name}")


class _Rows:
    """Reading a segment, in tasks."""

    path: str
    low: int | None = None
    high: int | None = None
    key: str

    def read(self, partition: Segment | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # where no segment is left
            return
        fs, root = pafs.FileSystem.from_uri(partition.path)
        with fs.open_input_file(root) as f:
            for batch in pa.ipc.open_stream(f):
                for bound, keep in ((partition.low, pc.greater_equal), (partition.high, pc.less_equal)):
                    if bound is not None:
                        batch = batch.filter(keep(batch.column(self.key), bound))
                yield batch


class SegmentReader(_Rows, DataSourceReader):
    def __init__(self, path: str, key: str):
        self.path, self.key = path, key

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes bounds of the key and leaves all other filters to Spark."""
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != (self.key,) or not isinstance(value, int):
                yield f
            elif isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                at_least = value + isinstance(f, GreaterThan) if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)) else None
                at_most = value - isinstance(f, LessThan) if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)) else None
                self.low = max((x for x in (self.low, at_least) if x is not None), default=None)
                self.high = min((x for x in (self.high, at_most) if x is not None), default=None)
            else:
                yield f

    def partitions(self) -> Sequence[Segment]:
        listed = [m for commit in manifests(self.path) for m in commit]
        bounded = self.low is not None or self.high is not None
        met = [m for m in listed if not bounded or (m["low"] is not None and (self.low is None or m["high"] >= self.low) and (self.high is None or m["low"] <= self.high))]
        return [Segment(f"{self.path}/{m['name']}", self.low, self.high) for m in met]


class SegmentStream(_Rows, DataSourceStreamReader):
    def __init__(self, path: str, key: str):
        self.path, self.key = path, key

    def initialOffset(self) -> dict:
        return {"commits": 0}

    def latestOffset(self) -> dict:
        return {"commits": len(manifests(self.path))}

    def partitions(self, start: dict, end: dict) -> Sequence[Segment]:
        commits = manifests(self.path)[start["commits"] : end["commits"]]
        return [Segment(f"{self.path}/{m['name']}") for commit in commits for m in commit]


class SegmentLog(DataSource):
    """Options: ``path``, a folder that driver and executors share, and ``key``, a column of longs."""

    @classmethod
    def name(cls) -> str:
        return "segments"

    def schema(self):
        raise ValueError("segments are read with a stated schema")

    def _at(self) -> tuple[str, str]:
        return self.options["path"], self.options["key"]

    def reader(self, schema) -> SegmentReader:
        return SegmentReader(*self._at())

    def streamReader(self, schema) -> SegmentStream:
        return SegmentStream(*self._at())

    def writer(self, schema, overwrite: bool) -> SegmentWriter:
        to_arrow_schema(schema).field(self.options["key"])  # an unknown key fails before any row is written
        return SegmentWriter(*self._at())


def register_segments(spark: SparkSession) -> None:
    spark.dataSource.register(SegmentLog)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
