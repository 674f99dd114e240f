"""Near-duplicate texts by MinHash bands (Broder, 1997), confirmed by the exact Jaccard similarity.

A text is the set of its ``width``-word shingles (lower-case A-Z; fewer words: all of them).  Texts of equal
sets are one node.  A node's signature holds the least value of each of ``bands * rows`` hash functions over
its shingles; nodes that agree on all rows of a band share a bucket.  Two sets of similarity s share one with
probability 1 - (1 - s ** rows) ** bands: with 32 bands of 4 rows, all but 5 in 10**8 pairs at 0.8.

1. Each node is compared with its bucket's first node.  In a group of copies that joins nearly all.
2. Buckets whose nodes are still of several components are cut into blocks of ``BLOCK`` nodes, and each two
   blocks meet once, in a task of fixed size: so a bucket of any size is shared out.  There pairs of different
   components are tested by their signatures, in the first band that they share only, and those
   that may be similar enough are compared exactly.

No bucket becomes all its pairs, and none is capped.  Sets are looked up only for nodes that have a candidate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.operators.components import components
from lodeframe.storage import sieved, stored

#: Nodes of a block, and shingles that are hashed at once.
BLOCK, LANES = 256, 4096
#: Pairs whose sets are compared at once.
PAIRS = 64
#: Signatures that agree in a smaller share of their rows than the threshold less this aren't compared
#: exactly: at 128 rows and a similarity of 0.8, 5.6 standard deviations.
SLACK = 0.2


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """The sorted hashes of the distinct shingles."""
    words = (text or "").encode().lower().split()
    runs = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if len(words) > width else [b" ".join(words)] if words else []
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs), np.uint64))


def hash_functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and summands of ``n`` hash functions."""
    numbers = np.array([xxhash.xxh64_intdigest(str(k)) for k in range(2 * n)], np.uint64)
    return numbers[:n] | np.uint64(1), numbers[n:]


def signature(own: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least of each function's upper 32 bits over the set (empty: the largest number)."""
    a, b = functions
    least = np.full(len(a), 0xFFFFFFFF, np.uint64)
    for k in range(0, len(own), LANES):
        x = own[k : k + LANES, None]
        np.minimum(least, ((((x ^ (x >> np.uint64(31))) * a) + b) >> np.uint64(32)).min(axis=0), out=least)
    return least.astype(np.uint32)


def band_keys(sig: np.ndarray, rows: int) -> list[int]:
    return [xxhash.xxh64_intdigest(part.tobytes()) - (1 << 63) for part in sig.reshape(-1, rows)]


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def _signed(texts: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(row, doc_id, digest of the set, signature, key of each band)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        functions = hash_functions(bands * rows)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                sets = [shingle_hashes(t, width) for t in part.column("text").to_pylist()]
                sigs = [signature(x, functions) for x in sets]
                digests = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array(digests, pa.binary()), pa.array([s.tobytes() for s in sigs], pa.binary()), pa.array([band_keys(s, rows) for s in sigs], pa.list_(pa.int64()))], ["row", "doc_id", "digest", "sig", "keys"])

    return texts.mapInArrow(sign, "row long, doc_id long, digest binary, sig binary, keys array<long>")


def _sets(nodes: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(node, own: its set) of the given nodes; other texts aren't shuffled."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                own = [shingle_hashes(t, width).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(own, pa.binary())], ["node", "own"])

    near = sieved(texts.select(F.col("row").alias("node"), "text"), nodes, "node")[1].join(nodes, "node", "left_semi")
    return stored(near.mapInArrow(cut, "node long, own binary"), "sets")


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # some pairs at a time, so that the sets of long texts aren't all copied at once
            for k in range(0, batch.num_rows, PAIRS):
                part = batch.slice(k, PAIRS)
                fits = [jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= threshold for x, y in zip(part.column("x").to_pylist(), part.column("y").to_pylist(), strict=True)]
                yield part.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    used = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "used")
    sets = _sets(used, texts, width)
    both = pairs.join(sets.selectExpr("node AS a", "own AS x"), "a").join(sets.selectExpr("node AS b", "own AS y"), "b")
    return stored(both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "confirmed")


def _rooted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    if links.isEmpty():
        return nodes.select("node", F.col("node").alias("root"))
    return stored(nodes.select("node").join(components(links), "node", "left").select("node", F.coalesce("root", "node").alias("root")), "roots")


def _block_pairs(buckets: DataFrame, nodes: DataFrame, roots: DataFrame, rows: int, threshold: float) -> DataFrame:
    """Pairs of nodes of different components in a bucket whose signatures may be similar enough."""
    keys = ["band", "key"]
    rooted = buckets.join(roots, "node")
    mixed = stored(rooted.groupBy(*keys).agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select(*keys, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "mixed")
    # a node's block depends on itself only; it meets all blocks, its own once
    dealt = rooted.join(mixed, keys).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = dealt.select(*keys, "node", "root", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(*keys, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root")

    def test(key: tuple, table: pa.Table) -> pa.Table:
        band, i, j = key[0].as_py(), key[2].as_py(), key[3].as_py()
        node, root, own = (np.asarray(table.column(c)) for c in ("node", "root", "own"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(len(node), -1)
        found = []
        for x in np.flatnonzero(own == i).tolist():
            other = np.flatnonzero((own == j) & (root != root[x]) & ((node > node[x]) | (i != j)))
            same = sig[other] == sig[x]
            shared = same.reshape(len(other), sig.shape[1] // rows, rows).all(axis=2)
            fits = (same.mean(axis=1) >= threshold - SLACK) & ~shared[:, :band].any(axis=1)
            found.extend((max(node[x], y), min(node[x], y)) for y in node[other[fits]].tolist())
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return met.join(nodes.select("node", "sig"), "node").groupBy("band", "key", "i", "j").applyInArrow(test, "a long, b long")


def near_duplicate_classes(docs: DataFrame, width: int = 5, threshold: float = 0.8, bands: int = 32, rows: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (the least id that links of similar texts reach, itself included).

    Null text counts as empty, and texts without words are one class; rows without an id take part, and
    class_id is null only where no member has an id; repeated rows give repeated rows; an empty table gives
    no rows; other columns are ignored.
    """
    numbered = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row")), "numbered")
    texts = numbered.select("row", "text")
    signed = stored(_signed(numbered, width, bands, rows), "signed")
    nodes = stored(signed.groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.first("sig").alias("sig"), F.first("keys").alias("keys")), "nodes")
    each = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    # stored, so that the join deals both sides out itself and can split a common key
    hubs = stored(each.groupBy("band", "key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").select("band", "key", "hub"), "hubs")
    buckets = stored(each.join(hubs, ["band", "key"]), "buckets")
    pairs = stored(buckets.where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "pairs")
    links = _confirmed(pairs, texts, width, threshold)
    roots = _rooted(nodes, links)
    more = stored(_block_pairs(buckets.drop("hub"), nodes, roots, rows, threshold).distinct().join(pairs, ["a", "b"], "left_anti"), "more")
    if not more.isEmpty():
        roots = _rooted(nodes, links.unionByName(_confirmed(more, texts, width, threshold)))
    rooted = stored(nodes.select("digest", "node", "least").join(roots, "node"), "rooted")
    least = stored(rooted.groupBy("root").agg(F.min("least").alias("class_id")), "least")
    classes = stored(rooted.join(least, "root").select("digest", "class_id"), "classes")
    return signed.select("doc_id", "digest").join(classes, "digest").select("doc_id", "class_id")
