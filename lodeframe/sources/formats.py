"""File formats: rows are written to the shared folder and read back with an explicit schema."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.storage import shared_path

OPTIONS = {"csv": {"header": "true"}, "xml": {"rowTag": "row"}}
#: XML files aren't split, so a task reads a whole one: each takes so many rows.
WRITE_OPTIONS = {"xml": {"maxRecordsPerFile": "50000"}}


def write(df: DataFrame, fmt: str, path: str, mode: str = "errorifexists") -> None:
    df.write.format(fmt).options(**OPTIONS.get(fmt, {}), **WRITE_OPTIONS.get(fmt, {})).mode(mode).save(path)


def read(spark, fmt: str, path: str, schema) -> DataFrame:
    """No schema is inferred: inference would read the data once more."""
    return spark.read.format(fmt).options(**OPTIONS.get(fmt, {})).schema(schema).load(path)


def round_trip(df: DataFrame, fmt: str) -> DataFrame:
    path = shared_path(df.sparkSession, fmt)
    write(df, fmt, path)
    return read(df.sparkSession, fmt, path, df.schema)


def partitioned(df: DataFrame, *columns: str) -> DataFrame:
    """A copy laid out by the values of ``columns``, for partition pruning.  Rows are dealt to
    writers by those values and a salt, so that a hot value has several writers and none writes
    a file for every value."""
    path = shared_path(df.sparkSession, "partitioned")
    salted = df.repartition(*columns, F.pmod(F.xxhash64(*df.columns), F.lit(8)))
    salted.write.partitionBy(*columns).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, buckets: int = 8) -> DataFrame:
    """A catalog table bucketed and sorted by ``column``, under a name of its own."""
    name = f"bucketed_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, column).sortBy(column).saveAsTable(name)
    return df.sparkSession.table(name)
