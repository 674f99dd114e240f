"""Making this package known to the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))


def ship_package(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once per application.

    Functions that run in Python workers are found there by their module's name, wherever the
    driver was started and whatever its search path.
    """
    context = spark.sparkContext
    if getattr(context, "_lodeframe_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="lodeframe-"), "lodeframe.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(HERE):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                out.write(full, os.path.relpath(full, os.path.dirname(HERE)))
    context.addPyFile(path)
    context._lodeframe_shipped = True


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``query``, with the package sent along before it runs."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run
