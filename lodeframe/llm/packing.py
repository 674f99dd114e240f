"""Packing into optimal length buckets.

A document is a tokenizer's tokens (or its words, where no tokenizer is named) and an end token; one of more than ``max_length`` tokens is cut into
sequences of that length and a rest, so nothing is dropped.  A histogram of the lengths of all
sequences (at most ``max_length`` bins, whatever the corpus) is gathered, and dynamic programming
chooses the ``n_buckets`` bucket bounds for which padding every sequence to its bucket's bound
costs the fewest tokens.  Inside each bucket batches of ``token_budget`` padded tokens are formed:
sequences are numbered through and every ``token_budget // bound`` make up a batch, so only a
bucket's last batch may be short.

Numbering does not gather a bucket in one task: sequences are dealt to shards by a hash, numbered
within each shard, and a shard's first number is the sum of the shards' counts before it.

Cases: null text counts as empty (one token, the end); a null id stays null; repeated rows give
repeated sequences; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.llm.texts import id_and_text
from lodeframe.llm.token_counts import token_counts
from lodeframe.storage import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Sequences in a shard, on average.
SHARD_ROWS = 100_000


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """The bounds of at most ``n_buckets`` buckets with the least padding; ``lengths`` ascend.

    best[k][i]: fewest padded tokens of the first i lengths in k buckets, the last of which ends
    at length i.
    """
    m = len(lengths)
    if not m:
        return []
    before = np.concatenate([[0], np.cumsum(counts)])
    # cost[j, i]: lengths j .. i - 1 padded to the last of them
    best = np.concatenate([[0.0], before[1:] * lengths.astype(np.float64)])
    best[0] = 0
    choice = [np.zeros(m + 1, np.int64)]
    layers = [best]
    for _ in range(1, min(n_buckets, m)):
        last, now, cut = layers[-1], np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        now[0] = 0
        for i in range(1, m + 1):
            cost = last[:i] + (before[i] - before[:i]) * float(lengths[i - 1])
            cut[i] = int(np.argmin(cost))
            now[i] = cost[cut[i]]
        layers.append(now)
        choice.append(cut)
    k = int(np.argmin([layer[m] for layer in layers]))
    bounds, i = [], m
    while i:
        bounds.append(int(lengths[i - 1]))
        i, k = (int(choice[k][i]), k - 1) if k else (0, 0)
    return bounds[::-1]


def sized(docs: DataFrame, tokenizer: str | None, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, size) of every document, its end counted."""
    if tokenizer is not None:
        return token_counts(docs, tokenizer, id_col=id_col, text_col=text_col).select("doc_id", (F.col("n_tokens") + 1).alias("size"))
    return id_and_text(docs, id_col, text_col).select("doc_id", (F.regexp_count("text", F.lit(WORD)) + 1).cast("long").alias("size"))


def sequences(docs: DataFrame, tokenizer: str | None, max_length: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, part, start, n_tokens) of every sequence."""
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {max_length}")))
    return sized(docs, tokenizer, id_col, text_col).select("doc_id", "size", parts.alias("part")).select(
        "doc_id", "part", (F.col("part") * max_length).alias("start"), F.least(F.lit(max_length).cast("long"), F.col("size") - F.col("part") * max_length).alias("n_tokens")
    )


def pack(docs: DataFrame, tokenizer: str | None = None, n_buckets: int = 16, max_length: int = 2048, token_budget: int = 65_536, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per sequence: doc_id, part, start and n_tokens within the document, its bucket's
    length, batch and slot in the batch."""
    if token_budget < max_length:
        raise ValueError("a batch must hold the longest sequence")
    numbered = stored(sequences(docs, tokenizer, max_length, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "sequences")
    histogram = sorted((r["n_tokens"], r["n"]) for r in numbered.groupBy("n_tokens").agg(F.count("*").alias("n")).collect())
    lengths, counts = np.array([x for x, _ in histogram], np.int64), np.array([n for _, n in histogram], np.int64)
    bounds = bucket_bounds(lengths, counts, n_buckets) or [max_length]
    shards = max(1, int(counts.sum()) // SHARD_ROWS)
    index = F.lit(len(bounds) - 1)
    for k in range(len(bounds) - 2, -1, -1):
        index = F.when(F.col("n_tokens") <= bounds[k], k).otherwise(index)
    limits = F.array(*map(F.lit, bounds))
    dealt = numbered.withColumn("bucket", index).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    sizes = dealt.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    ahead = sizes.select("bucket", "shard", (F.sum("n").over(Window.partitionBy("bucket").orderBy("shard")) - F.col("n")).alias("ahead"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "part", "row")) - 1)
    placed = ranked.join(ahead, ["bucket", "shard"]).withColumn("bucket_length", F.element_at(limits, F.col("bucket") + 1).cast("long")).withColumn("place", F.col("ahead") + F.col("rank"))
    return placed.select("doc_id", "part", "start", "n_tokens", "bucket_length", F.expr(f"place div ({token_budget} div bucket_length)").alias("batch"), F.expr(f"place % ({token_budget} div bucket_length)").alias("slot"))
