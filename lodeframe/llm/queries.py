"""The queries that ``__spark_entry__`` adds for this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodeframe.llm import crc_resampling, licenses, recompression
from lodeframe.llm.texts import documents


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeframe.llm.resampling import importance_resample

    return importance_resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir))


def op3_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeframe.llm.suffix_tree_lm import suffix_tree_scores

    return suffix_tree_scores(documents(spark, sf_dir))


def op4_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeframe.llm.repetition import repetition

    return repetition(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeframe.llm.packing import pack

    return pack(documents(spark, sf_dir), tokenizer_path())


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeframe.llm.pii import pii_spans

    return pii_spans(documents(spark, sf_dir))


def op7_sequence_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeframe.llm.sequence_files import sequence_digest

    return sequence_digest(documents(spark, sf_dir), tokenizer_path())


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeframe.llm.tiling import contaminated

    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeframe.llm.token_counts import token_counts

    return token_counts(documents(spark, sf_dir), tokenizer_path())


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeframe.llm.simhash import simhash_components

    return simhash_components(documents(spark, sf_dir))


def op11_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.removal_digest(documents(spark, sf_dir))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeframe.llm.whitening import whiten

    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_crc_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crc_resampling.crc_resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_importance_resampling,
        op2_license_scan,
        op3_suffix_tree_lm,
        op4_repetition,
        op5_packing,
        op6_pii,
        op7_sequence_files,
        op8_decontaminate,
        op9_token_counts,
        op10_simhash,
        op11_recompression,
        op12_whitening,
        op13_crc_resampling,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": licenses.oracle_sql(),
    "op11_recompression": recompression.oracle_sql(),
    "op13_crc_resampling": crc_resampling.oracle_sql(),
}
