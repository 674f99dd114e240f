"""Running a stream over files to its end."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from lodeframe.storage import shared_path

#: The state store that typed state needs.
PROVIDER, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 1) -> DataFrame:
    """A table's files as a stream; its schema is the table's own."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # a single file or a folder of files, either by its name
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")


class Feed:
    """A folder that gets ``parts`` one after the other, each in as many files as it has partitions, and the
    stream over it.  ``to_table`` runs the stream to its end after each part and starts it anew from its
    checkpoint for the next, as a job that was stopped and resumed."""

    def __init__(self, parts: list[DataFrame], label: str):
        self.parts = parts
        self.path = shared_path(parts[0].sparkSession, label)

    def stream(self) -> DataFrame:
        spark = self.parts[0].sparkSession
        self._give(0)
        return spark.readStream.schema(self.parts[0].schema).option("pathGlobFilter", "*.parquet").parquet(self.path)

    def _give(self, k: int) -> None:
        self.parts[k].write.mode("append").parquet(self.path)

    def steps(self) -> Iterator[None]:
        """Once for each part, when it is there; the stream has the first part from its start."""
        yield
        for k in range(1, len(self.parts)):
            self._give(k)
            yield


@contextmanager
def _rocksdb(spark: SparkSession, wanted: bool) -> Iterator[None]:
    before = spark.conf.get(PROVIDER, None)
    if wanted:
        spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if wanted:
            spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def to_table(stream: DataFrame, mode: str, feed: Feed | None = None, rocksdb: bool = False, once: bool = False, progress: list[dict] | None = None) -> DataFrame:
    """All rows that the stream gives in ``mode`` ("append", "complete", "update") over what is there
    now, or over each part of ``feed``, through Parquet files of the shared folder.  ``progress`` takes each
    batch's report.  ``once`` takes a part as one batch: state with a time to live asks for batches without end."""
    spark = stream.sparkSession
    path, checkpoint = shared_path(spark, "stream"), shared_path(spark, "stream-checkpoint")
    for _ in feed.steps() if feed else [None]:
        if mode == "append":
            sink = stream.writeStream.format("parquet").option("path", path)
        else:  # complete: each batch holds the whole result, the last one stands; update: all changes
            # a batch that runs again overwrites its own folder
            at = (lambda n: path) if mode == "complete" else (lambda n: f"{path}/batch={n}")
            sink = stream.writeStream.foreachBatch(lambda batch, n, at=at: batch.write.mode("overwrite").parquet(at(n)))
        with _rocksdb(spark, rocksdb):
            running = sink.outputMode(mode).option("checkpointLocation", checkpoint).queryName(f"q{uuid.uuid4().hex}").trigger(**({"once": True} if once else {"availableNow": True})).start()
            running.awaitTermination()
        if progress is not None:
            progress.extend(running.recentProgress)
    return spark.read.schema(stream.schema).parquet(path)


def state_counts(progress: list[dict], name: str) -> int:
    """A state operator's counter, such as ``numRowsDroppedByWatermark``, over all batches."""
    operators = [o for p in progress for o in p["stateOperators"]]
    return sum(o[name] if name in o else (o.get("customMetrics") or {}).get(name, 0) for o in operators)
