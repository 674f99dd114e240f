"""Contamination by shared word n-grams: which documents hold an n-gram of a benchmark.

The benchmark's n-grams set bits of a map of fixed size (``BITS``), which alone is sent to the tasks; a
document's n-grams are hashed in one sweep from its words' hashes and looked up there.  Only n-grams that hit
the map are given out, as text, and joined with the benchmark's exactly, so documents without a hit are
never shuffled, and neither a large benchmark nor a full map changes the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.storage import stored

#: Bits of the map: 8 MB, in words of 64.
BITS = 1 << 26
BASE = np.uint64(0x9E3779B97F4A7C15)


def ngram_hashes(words: list[bytes], n: int) -> np.ndarray:
    """A hash of each run of n words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    m = len(words) - n + 1
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * BASE + own[k : k + m]
    return out ^ (out >> np.uint64(32))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _grams(batches: Iterator[pa.RecordBatch], n: int, size: int, bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(id, place: the n-gram's bit, gram) of each text's distinct n-grams; with ``bits``, of those that are set there.  ``size``: the number of bits."""
    for batch in batches:
        ids, places, grams = [], [], []
        for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = _words(text)
            place = ngram_hashes(words, n) % np.uint64(size)
            at = range(len(place)) if bits is None else np.flatnonzero((bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)).tolist()
            own = {b" ".join(words[k : k + n]): int(place[k]) for k in at}
            ids += [i] * len(own)
            places += own.values()
            grams += own
            if len(grams) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int64()), pa.array(grams, pa.binary())], ["id", "place", "gram"])
                ids, places, grams = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int64()), pa.array(grams, pa.binary())], ["id", "place", "gram"])


def contaminated_by_ngrams(docs: DataFrame, benchmark: DataFrame, n: int = 8, id_col: str = "doc_id", text_col: str = "text", item_text_col: str = "text") -> DataFrame:
    """(doc_id, shared: how many distinct n-grams of the benchmark the document holds) of all documents that hold one.

    Words are runs without white space, A-Z in lower case.  Texts of fewer than n words and nulls hold none;
    repeated rows give repeated rows and rows without an id take part; empty tables give no rows.
    """
    schema, size = "id long, place long, gram binary", BITS
    items = benchmark.select(F.lit(0).cast("long").alias("id"), F.col(item_text_col).alias("text"))
    wanted = stored(items.mapInArrow(lambda batches: _grams(batches, n, size, None), schema).select("place", "gram").distinct(), "grams")
    word = (F.col("place") / 64).cast("long")
    rows = wanted.groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 AS int))")).alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[np.asarray(rows.column("word"))] = np.asarray(rows.column("bits")).astype(np.int64).view(np.uint64)
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    numbered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("id"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = dict(zip(batch.column("id").to_pylist(), batch.column("doc_id").to_pylist(), strict=True))
            for found in _grams(iter([batch]), n, size, sent.value):
                doc_ids = pa.array([named[i] for i in found.column("id").to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([found.column("id"), doc_ids, found.column("gram")], ["id", "doc_id", "gram"])

    # stored: a row's number must not change between attempts, and few rows are left
    hits = stored(numbered.mapInArrow(look, "id long, doc_id long, gram binary"), "hits")
    exact = hits.join(wanted.select("gram"), "gram", "left_semi")
    return exact.groupBy("id", "doc_id").agg(F.count("*").alias("shared")).select("doc_id", "shared")
