"""Language identification: a multinomial model of hashed character trigrams for each language.

Models are counted over all rows whose language is known and that aren't held out; each task adds
up counts per language and bucket, so a shuffled row stands for a bucket.  Models have ``buckets`` numbers a
language and ``MOST`` languages at most, which bounds what is sent to the tasks.  Scoring is a sum over a text's
trigrams, in Arrow batches without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Languages at most, and code points that are taken at a time.
MOST, CHUNK = 256, 1 << 20


def trigrams(text: str, buckets: int) -> np.ndarray:
    """The buckets of a text's character trigrams."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return (c[:-2] * 1_000_003 + c[1:-1] * 8_191 + c[2:]) % buckets if len(c) > 2 else np.zeros(0, np.int64)


def _pieces(text: str | None, buckets: int) -> Iterator[np.ndarray]:
    text = text or ""
    for k in range(0, max(1, len(text) - 2), CHUNK):
        yield trigrams(text[k : k + CHUNK + 2], buckets)


def identify_languages(docs: DataFrame, held_out: Column, buckets: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, lang, held_out, predicted (of equal scores the least name).

    ``held_out`` says of a document whether it is kept from training.  Texts of fewer than three characters (and
    nulls) have no trigram and get null, as all do where no language is known; rows without a language are
    scored, not learned from; repeated rows count each time; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.col(text_col)).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    fit = rows.where("NOT held_out AND lang IS NOT NULL")
    known = {r["lang"]: r["n"] for r in fit.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST + 1).collect()}
    if len(known) > MOST:
        raise ValueError(f"more than {MOST} languages")
    if not known:
        return rows.select("doc_id", "lang", "held_out", F.lit(None).cast("string").alias("predicted"))
    names = sorted(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = total.setdefault(lang, np.zeros(buckets, np.int64))
                for found in _pieces(text, buckets):
                    np.add.at(own, found, 1)
        for lang, own in total.items():
            met = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([names.index(lang)] * len(met), pa.int32()), pa.array(met.astype(np.int32)), pa.array(own[met])], ["model", "bucket", "n"])

    sums = fit.select("lang", "text").mapInArrow(count, "model int, bucket int, n long").groupBy("model", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(names), buckets))
    counts[np.asarray(sums.column("model")), np.asarray(sums.column("bucket"))] = np.asarray(sums.column("n"))
    log_share = np.log((counts + 1) / (counts.sum(axis=1, keepdims=True) + buckets))
    prior = np.log(np.array([known[n] for n in names]) / sum(known.values()))
    sent = docs.sparkSession.sparkContext.broadcast((names, prior, np.ascontiguousarray(log_share.T)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, prior, shares = sent.value
        for batch in batches:
            best = []
            for text in batch.column("text").to_pylist():
                total = prior + sum(shares[found].sum(axis=0) for found in _pieces(text, buckets))
                best.append(names[int(total.argmax())] if text and len(text) > 2 else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), batch.column("held_out"), pa.array(best, pa.string())], ["doc_id", "lang", "held_out", "predicted"])

    return rows.mapInArrow(score, "doc_id long, lang string, held_out boolean, predicted string")
