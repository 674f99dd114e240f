"""Where intermediate tables and checkpoints go.

On a cluster the folder is the one named in ``spark.checkpoint.dir``: the driver and all
executors see it.  Only where that setting is missing and the master is this process (tests on
one machine) a local folder is made; elsewhere its absence is an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The shared folder of this session, as a URI without a trailing slash."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "lodeframe-" + spark.sparkContext.applicationId)
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    This cuts the lineage: rows no longer depend on the order in which a lost task is run
    again, and the files outlive every executor.
    """
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Words of 64 bits in a sieve.
WORDS = 1 << 20


def sieved(rows: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts: those whose ``key`` isn't among ``ids`` for certain, and the others.

    The ids set bits of a map of fixed size (at most ``WORDS`` rows), which alone is broadcast; so
    wide rows needn't be shuffled to learn that they have no partner.
    """
    word = F.pmod(F.xxhash64(key), F.lit(WORDS))
    bit = f"cast(pmod(shiftright(xxhash64({key}), 32), 64) AS int)"
    bits = ids.select(word.alias("__word"), F.expr(f"shiftleft(1L, {bit})").alias("bit")).groupBy("__word").agg(F.bit_or("bit").alias("__bits"))
    marked = rows.withColumn("__word", word).join(F.broadcast(stored(bits, "sieve")), "__word", "left")
    hit = F.coalesce(F.expr(f"shiftrightunsigned(__bits, {bit}) & 1L") == 1, F.lit(False))
    return marked.where(~hit).select(*rows.columns), marked.where(hit).select(*rows.columns)


def publish(fs, written: str, final: str) -> None:
    """Give a finished file its name.  Where a rename doesn't replace and an earlier attempt of
    the same task was first, its file, the same by construction, stays."""
    try:
        fs.move(written, final)
    except OSError:
        if not fs.get_file_info(final).is_file:
            raise
        fs.delete_file(written)
