"""Importance resampling towards a target corpus, features hashed by CRC combination.

A feature is a run of 1 to ``longest`` words, joined by one space, and its bucket is the CRC-32 of its bytes
modulo ``buckets``.  The CRC of each distinct word is computed once.  Appending n bytes to a text shifts its CRC
by a linear map over GF(2) that depends on n only, so crc(a + b) = shift(crc(a), len(b)) xor crc(b); the map
of n bytes is the product of the maps of n's powers of two.  Runs' CRCs thus come from their words' CRCs and
lengths, a whole batch at a time, and no run is ever put together as a string.

All documents are counted per bucket, and all target texts.  A bucket's gain is
floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))).  A document's weight is the floored mean of its
features' gains, its score is the weight plus Gumbel noise drawn from a hash of its id, and of the documents
with ``least_words`` words the best ``percent`` per cent are drawn, ties to the smaller id.

Counts reach the driver as one row per bucket.  Gains and noise are bounded (below 50,000 and 25,000 in size), so
scores have at most some 150,000 values: their counts give each score the number of rows before it, and ranks
inside a score are given where its rows meet.  No task sorts all rows.

Cases: null and empty texts have no feature (weight 0) and can't be drawn; rows without an id take part with the
noise of the empty id and come last of a tie; repeated rows have consecutive ranks; an empty target gives
gains by the documents' counts alone; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.texts import as_bytes, id_and_text, sliced, sums_by
from lodeframe.storage import stored

#: CRC-32's polynomial, its bits in reverse order.
POLYNOMIAL = 0xEDB88320
#: What bytes of a text become: A-Z lower case, word characters themselves, all others a space.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


# ------------------------------------------------------------------------------------ CRC algebra


def _times(matrix: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """A linear map over GF(2), given by its values on the 32 bits, of each vector."""
    out = np.zeros_like(vectors)
    for bit in range(32):
        out ^= np.where((vectors >> np.uint32(bit)) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


@lru_cache(maxsize=64)
def shift_tables(power: int) -> np.ndarray:
    """The map that appending 2 ** power zero bytes makes of a CRC, as its values on each of 4 x 256 bytes."""
    if power:
        half = shift_tables(power - 1)
        matrix = _shifted_once(half, _shifted_once(half, np.uint32(1) << np.arange(32, dtype=np.uint32)))
    else:
        matrix = np.uint32(1) << np.arange(32, dtype=np.uint32)
        for _ in range(8):  # a zero bit
            matrix = (matrix >> np.uint32(1)) ^ np.where(matrix & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    every = np.arange(256, dtype=np.uint32)
    return np.stack([_times(matrix, every << np.uint32(8 * k)) for k in range(4)])


def _shifted_once(tables: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    out = tables[0][crcs & np.uint32(255)]
    for k in range(1, 4):
        out = out ^ tables[k][(crcs >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRCs' share in the CRC of a text that goes on by so many bytes."""
    out = crcs.copy()
    for power in range(int(lengths.max(initial=0)).bit_length()):
        at = np.flatnonzero((lengths >> power) & 1)
        out[at] = _shifted_once(shift_tables(power), out[at])
    return out


def combined(first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of a + b from those of a and b and b's length."""
    return shifted(first, lengths) ^ second


class WordCrcs(defaultdict):
    """(CRC-32 of a word, of a space and the word, the word's length), computed once."""

    def __missing__(self, word: bytes) -> tuple[int, int, int]:
        if len(self) > 500_000:
            self.clear()
        self[word] = own = zlib.crc32(word), zlib.crc32(word, zlib.crc32(b" ")), len(word)
        return own


def features(texts: list[bytes], longest: int, buckets: int, known: WordCrcs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of the texts' features, text by text; where each text's begin; the texts' words."""
    words = [t.translate(LETTERS).split() for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    own = np.array(list(map(known.__getitem__, chain.from_iterable(words))), np.int64).reshape(-1, 3)
    crc, spaced, length = own[:, 0].astype(np.uint32), own[:, 1].astype(np.uint32), own[:, 2] + 1
    text = np.repeat(np.arange(len(n)), n)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(text))  # words from here to the text's end
    found, owner, run = [crc], [text], crc
    for k in range(1, longest):
        # runs of k + 1 words from those of k: those that go on
        run = combined(run[: len(run) - 1], spaced[k:], length[k:]) if len(run) else run
        has = left[: len(run)] > k
        found.append(run[has])
        owner.append(text[: len(run)][has])
    owners = np.concatenate(owner)
    order = np.argsort(owners, kind="stable") if longest > 1 else slice(None)
    return (np.concatenate(found)[order] % np.uint32(buckets)).astype(np.int64), np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(n)))]), n


# ------------------------------------------------------------------------------------- resampling


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How often each bucket is met in the column ``text``; one row per bucket is gathered."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = np.zeros(buckets, np.int64), WordCrcs()
        for batch in sliced(batches):
            total += np.bincount(features(as_bytes(batch.column("text")), longest, buckets, known)[0], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])

    sums = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[np.asarray(sums.column("bucket"))] = np.asarray(sums.column("n"))
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    b, s_all, t_all = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((t + 1) * (s_all + b)) / float((s + 1) * (t_all + b)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """floor(-1000 ln(-ln u)) of a u in (0, 1) that the id gives."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def crc_resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (null: not drawn)."""
    rows = id_and_text(docs, id_col, text_col)
    raw = bucket_counts(rows, longest, buckets)
    wanted = bucket_counts(target.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")), longest, buckets)
    sent = docs.sparkSession.sparkContext.broadcast(gains(raw, wanted))  # 8 bytes a bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordCrcs()
        for batch in sliced(batches):
            found, offsets, n_words = features(as_bytes(batch.column("text")), longest, buckets, known)
            n = np.diff(offsets)
            weight = sums_by(sent.value[found], offsets) // np.maximum(n, 1)
            score = weight + np.array([noise(i, seed) for i in batch.column("doc_id").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(weight), pa.array(score), pa.array(n_words >= least_words)], ["doc_id", "n_features", "weight", "score", "may"])

    weighed = stored(rows.mapInArrow(weigh, "doc_id long, n_features long, weight long, score long, may boolean"), "weighed")
    return _drawn(weighed, percent)


def _drawn(weighed: DataFrame, percent: int) -> DataFrame:
    """``weighed`` with the ranks of the best ``percent`` per cent of the rows that may be drawn."""
    spark = weighed.sparkSession
    columns = ["doc_id", "n_features", "weight", "score"]
    counts = {r["score"]: r["n"] for r in weighed.where("may").groupBy("score").agg(F.count("*").alias("n")).collect()}
    draw, before, places = percent * sum(counts.values()) // 100, 0, []
    for score in sorted(counts, reverse=True):
        if before >= draw:
            break
        places.append((score, before))
        before += counts[score]
    if not places:
        return weighed.select(*columns, F.lit(None).cast("long").alias("rank"))
    # a row per score, whose number is bounded
    ahead = F.broadcast(spark.createDataFrame(places, "score long, before long"))
    best = F.col("may") & (F.col("score") >= places[-1][0])
    inside = F.expr("row_number() OVER (PARTITION BY score ORDER BY doc_id NULLS LAST)")
    ranked = weighed.where(best).withColumn("inside", inside).join(ahead, "score").withColumn("rank", (F.col("before") + F.col("inside")).cast("long"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    return ranked.select(*columns, "rank").unionByName(weighed.where(~best).select(*columns, F.lit(None).cast("long").alias("rank")))


def oracle_sql(buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10) -> str:
    """``crc_resample`` of ``documents`` towards ``benchmark`` with single words, each word's CRC byte by byte."""
    capitals, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{capitals}', '{small}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    step = f"CASE WHEN c & 1 = 1 THEN xor(c >> 1, {POLYNOMIAL}::BIGINT) ELSE c >> 1 END"
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
    doc_words AS (SELECT r, unnest(w) AS word FROM docs),
    target_words AS (SELECT unnest({words}) AS word FROM benchmark),
    byte_crc AS (SELECT list(list_reduce(range(8), lambda c, k: {step}, b) ORDER BY b) AS t FROM range(256) AS x(b)),
    bytes AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM doc_words UNION SELECT word FROM target_words)),
    crcs AS (SELECT word, xor(4294967295::BIGINT, list_reduce(list_transform(range(len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)) % {buckets} AS bucket FROM bytes, byte_crc),
    raw AS (SELECT bucket, count(*) AS s FROM doc_words JOIN crcs USING (word) GROUP BY bucket),
    wanted AS (SELECT bucket, count(*) AS t FROM target_words JOIN crcs USING (word) GROUP BY bucket),
    sums AS (SELECT (SELECT CAST(coalesce(sum(s), 0) AS BIGINT) FROM raw) AS s_all, (SELECT CAST(coalesce(sum(t), 0) AS BIGINT) FROM wanted) AS t_all),
    gains AS (SELECT raw.bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (s_all + {buckets}) AS DOUBLE) / CAST((s + 1) * (t_all + {buckets}) AS DOUBLE))) AS BIGINT) AS gain FROM raw LEFT JOIN wanted USING (bucket), sums),
    weights AS (SELECT r, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM doc_words JOIN crcs USING (word) JOIN gains USING (bucket) GROUP BY r),
    scored AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
      coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score,
      len(w) >= {least_words} AS may FROM docs LEFT JOIN weights USING (r)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (WHERE may) OVER () AS n FROM scored)
    SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= {percent} * n // 100 THEN place END AS rank FROM ranked"""
