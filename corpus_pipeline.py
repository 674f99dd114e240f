"""The corpus pipeline: repetition rules, near-duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns
them with the columns of ``documents``; the last returns packed sequences.  ``run`` writes each
stage's rows to the shared folder as Parquet and reads them back as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm.near_duplicates import drop_near_duplicates
from lodeframe.llm.packing import pack
from lodeframe.llm.pii import mask_pii
from lodeframe.llm.queries import tokenizer_path
from lodeframe.llm.repetition import keep_unrepetitive
from lodeframe.llm.texts import documents
from lodeframe.llm.tiling import drop_contaminated
from lodeframe.storage import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_unrepetitive(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their personal data masked; n_chars follows the text."""
    return mask_pii(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: The stages aren't SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
