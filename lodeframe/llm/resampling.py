"""Quality by importance resampling (Xie et al., "Data Selection for Language Models via
Importance Resampling", 2023).

Features are a text's words (A-Z lower-cased) and pairs of neighbouring words, hashed to
``buckets``.  Two multinomial models over the buckets, one of the target texts and one of all raw
texts, give each document the log importance weight: the sum over its features of
log target(bucket) - log raw(bucket).  Each document's key is its weight plus Gumbel noise drawn
from a hash of its id and text, and the ``k`` largest keys are kept, which samples ``k`` documents
without replacement in proportion to their weights.

The target is fitted on a bounded sample: of the labelled documents at most ``label_sample`` (the
smallest hashes of the id), those of good quality that are not toxic.  The raw model counts all
documents.  ``k`` is the target's share of that sample, of all documents, unless ``share`` says
otherwise.

The k-th largest key is found by counting keys by ever longer prefixes of their bits, 16 at a
time, so no sort of all keys, no limit and no collected rows are needed; ties at the last place
are broken by the smallest id, then by hash, and rows that are equal in all share their fate.

Cases: null text counts as empty (weight 0); rows without an id take part by their text; repeated
rows give repeated rows; an empty table gives no rows; without labels all weights are 0 and, as no
share is known, every document is kept; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.texts import as_bytes, id_and_text, sliced, sums_by
from lodeframe.storage import stored

SCHEMA = "doc_id long, n_features long, log_weight double, key double, kept boolean"


class _Hashes(defaultdict):
    """crc32 of a word, computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = value = zlib.crc32(word)
        return value


def features(texts: list[bytes], buckets: int, hashes: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all features of the texts in a row, and where each text's begin."""
    words = [t.lower().split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter(map(hashes.__getitem__, chain.from_iterable(words)), np.uint64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    # each word, then the pair that it begins (none for a text's last word)
    own = flat % np.uint64(buckets)
    pair = np.empty_like(flat)
    mixed = (flat[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (flat[1:] + np.uint64(0x7F4A7C15))
    pair[:-1] = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)
    both = np.column_stack([own, pair % np.uint64(buckets)]).ravel().astype(np.int64)
    real = np.ones(len(both), bool)
    real[2 * ends[sizes > 0] - 1] = False
    return both[real], np.concatenate([[0], np.cumsum(np.maximum(2 * sizes - 1, 0))])


def _models(rows: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each bucket in the texts with target = 1 and in all; one row per bucket is
    gathered."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target, hashes = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64), _Hashes()
        for batch in sliced(batches):
            found, offsets = features(as_bytes(batch.column("text")), buckets, hashes)
            raw += np.bincount(found, minlength=buckets)
            wanted = np.repeat(np.asarray(batch.column("target")), np.diff(offsets))
            target += np.bincount(found[wanted == 1], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(raw), pa.array(target)], ["bucket", "raw", "target"])

    sums = rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    at = np.asarray(sums.column("bucket"))
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[at], target[at] = np.asarray(sums.column("raw")), np.asarray(sums.column("target"))
    return target, raw


def importance_resample(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 16, label_sample: int = 20_000, share: float | None = None, seed: int = 42, smoothing: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its number of features, weight, key and whether it is kept."""
    rows = id_and_text(docs, id_col, text_col)
    sample = labels.where("doc_id IS NOT NULL").selectExpr("CAST(doc_id AS BIGINT) AS label_id", "coalesce(quality, 0) = 1 AND coalesce(toxic, 0) = 0 AS good").groupBy("label_id").agg(F.min("good").alias("good")).orderBy(F.xxhash64("label_id"), "label_id").limit(label_sample).collect()
    good = [r["label_id"] for r in sample if r["good"]]
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(i,) for i in good], "label_id long").withColumn("yes", F.lit(1))
    # at most label_sample ids of 8 bytes: a proven bound
    marked = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"), "left").select("text", F.coalesce("yes", F.lit(0)).cast("long").alias("target"))
    target, raw = _models(marked, buckets)
    ratio = np.log((target + smoothing) / (target.sum() + smoothing * buckets)) - np.log((raw + smoothing) / (raw.sum() + smoothing * buckets)) if good else np.zeros(buckets)
    sent = spark.sparkContext.broadcast(ratio)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in sliced(batches):
            texts = as_bytes(batch.column("text"))
            found, offsets = features(texts, buckets, hashes)
            weight = sums_by(sent.value[found], offsets)
            draws = np.fromiter(map(_draw, batch.column("doc_id").to_pylist(), texts), np.uint64, len(texts))
            uniform = ((draws >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
            key = weight - np.log(-np.log(uniform))
            bits = key.view(np.int64)
            # doubles in the order of longs
            order = np.where(bits < 0, np.bitwise_xor(bits, np.int64(0x7FFFFFFFFFFFFFFF)), bits)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(weight), pa.array(key), pa.array(order), pa.array(draws.view(np.int64))], ["doc_id", "n_features", "log_weight", "key", "place", "draw"])

    def _draw(doc_id: int | None, text: bytes) -> int:
        return xxhash.xxh64_intdigest(str(doc_id).encode() + b"\0" + text, seed)

    weighed = stored(rows.mapInArrow(weigh, "doc_id long, n_features long, log_weight double, key double, place long, draw long"), "weights")
    n = weighed.count()
    kept_share = share if share is not None else (len(good) / len(sample) if sample else 1.0)
    return _top(weighed, min(n, round(n * kept_share)))


def _top(weighed: DataFrame, k: int) -> DataFrame:
    """Mark the ``k`` rows of the largest places."""
    columns = [F.col("doc_id"), F.col("n_features"), F.col("log_weight"), F.col("key")]
    if k <= 0:
        return weighed.select(*columns, F.lit(False).alias("kept"))
    tie_keys = [("place", False), ("doc_id", True), ("draw", True)]
    condition, within = F.lit(False), F.lit(True)
    left = k
    for name, ascending in tie_keys:
        # as an unsigned number that is largest for what comes first; no id comes last
        value = F.coalesce(F.col(name), F.lit((1 << 63) - 1)) if ascending else F.col(name)
        value = F.bitwise_not(value) if ascending else value
        number = value.bitwiseXOR(F.lit(-(1 << 63)))
        for shift in (48, 32, 16, 0):
            digit = F.shiftrightunsigned(number, shift).bitwiseAND(0xFFFF)
            counts = {r["digit"]: r["n"] for r in weighed.where(within).groupBy(digit.alias("digit")).agg(F.count("*").alias("n")).collect()}
            edge = None
            for d in sorted(counts, reverse=True):  # at most 65,536 digits
                edge = d
                if counts[d] >= left:
                    break
                left -= counts[d]
            condition = condition | (within & (digit > edge))
            within = within & (digit == edge)
            if counts[edge] == left:
                return weighed.select(*columns, (condition | within).alias("kept"))
    # rows equal in all: the last place takes all of them
    return weighed.select(*columns, (condition | within).alias("kept"))
