"""Near-duplicates: one document of each group of texts that share their 5-word shingles.

Links join texts whose sets of ``width``-word shingles have a Jaccard similarity of at least
``threshold``.  A single SimHash of shingles at a small radius is too coarse for that (it found one
in six such pairs), so a text has ``tables`` fingerprints of its distinct words; texts within the
radius in any of them, found with BK-trees in shards as in ``simhash``, may be linked.  Texts with
equal sets are one node.

1. In each shard a node is compared with the first node of its own fingerprint and the first of the
   fingerprint nearby that most nodes are near to.  In a group of copies that is mostly the original,
   so a few comparisons a node make most components.
2. All other pairs within the radius whose nodes are not in one component are compared, too: pair by
   pair in shards with few of them, else in blocks of nodes that meet once.  A block gives only the
   links that join its components, so no group of copies becomes all its pairs.

Texts of the same words in other orders share all fingerprints without being near.  In shards of more than a quarter of
``limit`` nodes of one fingerprint the pairs of step 2 are therefore those that share a shingle among the rarest of each
(prefix filtering), which all pairs do that reach the threshold.  So a link depends on its two texts only, not on how
many others there are.

Of each component one row stays: the one with the least id (a null id last), of several the least
by a hash of the text; nothing depends on the rows' order, but for rows that are equal in both.

Cases: null text counts as empty, and texts without words are one node; rows without an id take
part like any other; of repeated rows one stays, and rows that share an id but no text are
different documents; an empty table gives no rows; other columns are returned untouched.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.llm.simhash import LANES, SEED, BKTree, in_shards, in_turn, majorities, word_hashes
from lodeframe.llm.texts import as_bytes, sliced
from lodeframe.operators.components import components
from lodeframe.storage import sieved, stored

#: Nodes, and shingles in their sets, of a part of a block.
PART_NODES, PART_SHINGLES = 1024, 1_000_000
#: Shards of so many nodes at most are looked through side by side.
SMALL = 128
#: A shard with more open pairs than so many a node is compared in blocks.
DENSE = 1


def _distinct(hashes: np.ndarray) -> np.ndarray:
    own = np.sort(hashes)
    return own[np.append(True, own[1:] != own[:-1])] if len(own) else own


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The sorted hashes of the distinct shingles (fewer words: of all of them), each a sum of its words' hashes times
    powers of an odd number by their places."""
    n = len(words) - width + 1
    if n < 1:
        width, n = len(words), min(1, len(words))
    own = np.zeros(n, np.uint64)
    for k in range(width):
        own += words[k : k + n] * np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64))
    return _distinct(own)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    return shingle_hashes(word_hashes([text])[0], width)


def _digest_of(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


class Shard:
    """One shard's nodes by fingerprint, and which fingerprints are within the radius."""

    def __init__(self, members: list[tuple[int, int, int, int]], radius: int):
        """``members``: (fp, node, size, root)"""
        self.members = members
        self.at: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for fp, node, size, root in sorted(members):
            self.at[fp].append((node, size, root))
        tree = BKTree()
        self.near: list[tuple[int, int]] = []
        for fp in self.at:
            self.near.extend((fp, tree.values[k]) for k in tree.within(fp, radius))
            tree.add(fp)

    def first_pairs(self) -> Iterator[tuple[int, int]]:
        """Pairs of each node with its fingerprint's first node and with the first of a hub nearby."""
        degree = Counter({fp: len(nodes) for fp, nodes in self.at.items()})
        for x, y in self.near:
            degree[x] += len(self.at[y])
            degree[y] += len(self.at[x])
        hub: dict[int, int] = {}
        for x, y in chain(self.near, ((y, x) for x, y in self.near)):
            hub[x] = max(hub.get(x, y), y, key=lambda fp: (degree[fp], fp))
        for fp, nodes in self.at.items():
            for other in {self.at[fp][0][0], self.at[hub.get(fp, fp)][0][0]}:
                yield from ((max(node, other), min(node, other)) for node, _, _ in nodes if node != other)

    def open_pairs(self) -> int:
        """How many pairs within the radius aren't in one component."""
        roots = {fp: Counter(root for _, _, root in nodes) for fp, nodes in self.at.items()}
        n = 0
        for fp, own in roots.items():
            total = len(self.at[fp])
            n += (total * total - sum(c * c for c in own.values())) // 2
        for x, y in self.near:
            n += len(self.at[x]) * len(self.at[y]) - sum(c * roots[y][r] for r, c in roots[x].items())
        return n

    def pairs(self, threshold: float) -> Iterator[tuple[int, int]]:
        """Those pairs, if their sets' sizes allow a link."""
        for x, y in [*((fp, fp) for fp in self.at), *self.near]:
            for k, (node, size, root) in enumerate(self.at[x]):
                for other, other_size, other_root in self.at[y][: k if x == y else None]:
                    if root != other_root and min(size, other_size) >= threshold * max(size, other_size):
                        yield max(node, other), min(node, other)

    def blocks(self) -> Iterator[tuple[list[int], list[int]]]:
        """The shard's nodes in parts; each two parts (and each with itself, as the second is then
        empty) that aren't of one component."""
        parts: list[list[tuple[int, int]]] = [[]]
        n = 0
        for _, node, size, root in sorted(self.members, key=lambda m: (m[3], m[1])):
            if parts[-1] and (len(parts[-1]) >= PART_NODES or n + size > PART_SHINGLES):
                parts.append([])
                n = 0
            parts[-1].append((node, root))
            n += size
        roots = [{root for _, root in part} for part in parts]
        for i, x in enumerate(parts):
            for j, y in enumerate(parts[: i + 1]):
                if len(roots[i] | roots[j]) > 1:
                    yield [node for node, _ in x], [node for node, _ in y] if j < i else []


def _open_in_large(fps: np.ndarray, roots: np.ndarray, radius: int) -> np.ndarray:
    """Which rows have a fingerprint that is within the radius of one (or has itself rows) of another root."""
    own, at = np.unique(fps, return_inverse=True)
    low, high = np.full(len(own), np.iinfo(np.int64).max), np.full(len(own), np.iinfo(np.int64).min)
    np.minimum.at(low, at, roots)
    np.maximum.at(high, at, roots)
    step = max(1, LANES // len(own))
    found = np.zeros(len(own), bool)
    for k in range(0, len(own), step):
        part = slice(k, k + step)
        others = (low[part, None] < high) | (low < high[part, None])
        found[part] = ((np.bitwise_count(own[part, None] ^ own) <= radius) & others).any(axis=1)
    return found[at]


def open_rows(starts: np.ndarray, fps: np.ndarray, roots: np.ndarray, radius: int) -> np.ndarray:
    """Which rows of shards, which begin at ``starts``, have another of their shard within the radius and of another root (in
    large shards, some of their fingerprint have)."""
    sizes = np.diff(np.append(starts, len(fps)))
    found, ends = np.zeros(len(fps), bool), np.repeat(starts + sizes, sizes)
    at = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
    for lag in range(1, SMALL):
        at = at[at + lag < ends[at]]
        if not len(at):
            break
        near = at[np.bitwise_count(fps[at] ^ fps[at + lag]) <= radius]
        near = near[roots[near] != roots[near + lag]]
        found[near] = found[near + lag] = True
    for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        own = slice(start, start + size)
        found[own] = _open_in_large(fps[own], roots[own], radius)
    return found


def each_shard(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[tuple[tuple[int, int, int], Shard]]:
    """The shards, from rows that come shard by shard, of those nodes that have another of another root within the
    radius."""
    names = ("t", "mask", "bits", "fp", "node", "size", "root")

    def shards_of(rows: np.ndarray) -> Iterator[tuple[tuple[int, int, int], Shard]]:
        rows = rows[:, open_rows(_starts(rows), rows[3].view(np.uint64), rows[6], radius)]
        starts = _starts(rows).tolist()
        for start, end in zip(starts, [*starts, rows.shape[1]][1:], strict=True):
            yield tuple(rows[:3, start].tolist()), Shard([(fp & 0xFFFFFFFFFFFFFFFF, *x) for fp, *x in rows[3:, start:end].T.tolist()], radius)

    held = np.zeros((len(names), 0), np.int64)
    for batch in batches:
        held = np.concatenate([held, np.stack([batch.column(c).to_numpy().astype(np.int64) for c in names])], axis=1)
        if len(starts := _starts(held)) > 1:  # the last shard may go on
            yield from shards_of(held[:, : starts[-1]])
            held = held[:, starts[-1] :].copy()
    yield from shards_of(held)


def _starts(rows: np.ndarray) -> np.ndarray:
    """Where shards begin."""
    return np.flatnonzero(np.append(rows.shape[1] > 0, (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)))


def _batches(rows: Iterator[tuple], names: list[str], n: int = 50_000) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, n)):
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*some, strict=True)], names)


def _sets(used: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(node, own) of the nodes used: their texts' shingle sets, in 32 bits a shingle."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, limit=1 << 20):
            sets = [_distinct(shingle_hashes(x, width).astype(np.uint32)).tobytes() for x in word_hashes(as_bytes(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "own"])

    near = sieved(texts.select(F.col("row").alias("node"), "text"), used, "node")[1]
    own = near.join(used, "node", "left_semi").mapInArrow(cut, "node long, own binary")
    return stored(own, "sets")


def similar(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is ``threshold`` at least."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    if len(small) < threshold * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return both >= threshold * (len(x) + len(y) - both)


def _tested(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [similar(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), threshold) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(found, pa.bool_()))

    each = pairs.join(sets.selectExpr("node AS a", "own AS x"), "a").join(sets.selectExpr("node AS b", "own AS y"), "b")
    return each.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def _tested_blocks(blocks: DataFrame, sets: DataFrame, about: DataFrame, radius: int, threshold: float) -> DataFrame:
    """Links (a, b) that join the nodes of each block (block, t, side, node) as all links of nodes of
    its two sides do that are within the radius first in table ``t``."""

    def compare(table: pa.Table) -> pa.Table:
        side, t = np.asarray(table.column("side")), table.column("t")[0].as_py()
        node, root = (table.column(c).to_pylist() for c in ("node", "root"))
        fps = np.array(table.column("fps").to_pylist(), np.int64).view(np.uint64)
        own = [np.frombuffer(x, np.uint32) for x in table.column("own").to_pylist()]
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        found, alone = [], not side.any()
        for i in np.flatnonzero(side == 0).tolist():
            others = np.arange(i) if alone else np.flatnonzero(side == 1)
            near = np.bitwise_count(fps[others] ^ fps[i]) <= radius
            others = others[near.any(axis=1) & (near.argmax(axis=1) == t)]
            for j in others.tolist():
                a, b = top(root[i]), top(root[j])
                if a != b and similar(own[i], own[j], threshold):
                    parent[a] = b
                    found.append((max(node[i], node[j]), min(node[i], node[j])))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    rows = blocks.join(sets, "node").join(about, "node")
    return rows.select("block", "t", "side", "node", "root", "fps", "own").groupBy("block").applyInArrow(compare, "a long, b long")


def _prefix_pairs(nodes: DataFrame, sets: DataFrame, radius: int, threshold: float) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, root, fps) of different roots and within the radius, all that can reach the threshold among them.

    Sets x and y, x the smaller, reach a similarity of s only if they share s / (1 + s) * (|x| + |y|) shingles, 2 s / (1 + s) |x|
    at least.  So, in any order that is the same for both, they share one of the first |y| - s |y| + 1 of y that is among the
    first |x| - 2 s / (1 + s) |x| + 1 of x.  The order is by the number of nodes that hold a shingle, so such groups are small."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, root, own in zip(*(batch.column(c).to_pylist() for c in ("node", "root", "own")), strict=True):
                held = np.frombuffer(own, np.uint32).astype(np.int64)
                columns = [np.full(len(held), node), np.full(len(held), root), np.full(len(held), len(held)), held]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["node", "root", "n", "s"])

    rows = stored(nodes.select("node", "root").join(sets, "node").mapInArrow(spread, "node long, root long, n long, s long"), "spread")
    # stored, so that the join deals both sides out itself and can split a common shingle
    counts = stored(rows.groupBy("s").agg(F.count("*").alias("c"), (F.min("root") < F.max("root")).alias("open")), "counts")
    place = F.row_number().over(Window.partitionBy("node").orderBy("c", "s"))
    first = lambda share: F.col("n") - F.ceil(F.col("n") * share - 1e-6) + 1
    ranked = rows.join(counts, "s").withColumn("place", place).where(F.col("open") & (F.col("place") <= first(threshold)))
    keys = stored(ranked.select("s", "node", "root", "n", (F.col("place") <= first(2 * threshold / (1 + threshold))).alias("indexed")), "keys")
    x, y = (keys.select("s", *(F.col(c).alias(f"{side}_{c}") for c in ("node", "root", "n", "indexed"))) for side in "xy")
    smaller = (F.col("x_n") < F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_node") < F.col("y_node")))
    met = x.where("x_indexed").join(y, "s").where(smaller & (F.col("x_root") != F.col("y_root")) & (F.col("x_n") >= F.col("y_n") * threshold - 1e-6))
    pairs = stored(met.select(F.greatest("x_node", "y_node").alias("a"), F.least("x_node", "y_node").alias("b")).distinct(), "met")
    both = pairs.join(nodes.selectExpr("node AS a", "fps AS x"), "a").join(nodes.selectExpr("node AS b", "fps AS y"), "b")
    return both.where(F.exists(F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseXOR(q)) <= radius), lambda near: near)).select("a", "b")


def confirmed_roots(nodes: DataFrame, texts: DataFrame, radius: int, size: int, limit: int, width: int, threshold: float, dense: int = DENSE) -> DataFrame | None:
    """(node, root) of the nodes (node, fps, size) that a tested link joins to others; None if no
    link was found."""
    n, known = nodes.count(), []

    def shards(rooted: DataFrame, apart: list[DataFrame]) -> DataFrame:
        each = rooted.select("node", "size", "root", F.posexplode("fps").alias("t", "fp"))
        return in_turn(in_shards(each, n, radius, size, limit, known, apart))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((pair for _, shard in each_shard(batches, radius) for pair in shard.first_pairs()), ["a", "b"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(chain.from_iterable(_rest(key, shard) for key, shard in each_shard(batches, radius)), ["a", "b", "block", "t", "side"])

    def _rest(key: tuple[int, int, int], shard: Shard) -> Iterator[tuple]:
        if shard.open_pairs() <= dense * len(shard.members):
            yield from ((a, b, None, None, None) for a, b in shard.pairs(threshold))
            return
        for k, sides in enumerate(shard.blocks()):
            block = xxhash.xxh64_intdigest(repr((*key, k)).encode()) >> 1
            yield from ((node, None, block, key[0], side) for side in (0, 1) for node in sides[side])

    apart: list[DataFrame] = []
    pairs = shards(nodes.withColumn("root", F.col("node")), apart).mapInArrow(first, "a long, b long")
    same = None
    if apart:
        same = stored(reduce(DataFrame.unionByName, (x.select("t", "fp", "node") for x in apart)).distinct(), "same")
        hubs = stored(same.groupBy("t", "fp").agg(F.min("node").alias("b")), "hubs")
        pairs = pairs.unionByName(same.join(hubs, ["t", "fp"]).where("node != b").select(F.col("node").alias("a"), "b"))
    pairs = stored(pairs.distinct(), "pairs")
    used = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
    sets = _sets(used, texts, width)
    links = stored(_tested(pairs, sets, threshold), "tested")
    if links.isEmpty():
        roots = nodes.select("node", F.col("node").alias("root"))
    else:
        roots = stored(nodes.select("node").join(components(links), "node", "left").select("node", F.coalesce("root", "node").alias("root")), "roots")
    about = stored(nodes.join(used, "node", "left_semi").join(roots, "node"), "about")
    # each node that is near another has been in a pair, so the others needn't be looked at again, and its set is there
    more = stored(shards(about, []).mapInArrow(rest, "a long, b long, block long, t long, side long").distinct(), "more")
    tested = pairs.select("a", "b", F.lit(True).alias("tested"))
    met = more.where("block IS NULL").select("a", "b")
    if same is not None:
        mixed = same.join(about.select("node", "root"), "node").groupBy("t", "fp").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
        open_nodes = stored(about.join(same.join(stored(mixed.select("t", "fp"), "mixed"), ["t", "fp"], "left_semi").select("node").distinct(), "node", "left_semi").select("node", "root", "fps"), "open-nodes")
        met = met.unionByName(_prefix_pairs(open_nodes, sets, radius, threshold)).distinct()
    open_pairs = stored(met.join(tested, ["a", "b"], "left_anti"), "open")
    blocks = more.where("block IS NOT NULL").select("block", "t", "side", F.col("a").alias("node"))
    further = stored(_tested(open_pairs, sets, threshold).unionByName(_tested_blocks(blocks, sets, about.select("node", "fps", "root"), radius, threshold)), "further")
    every = links.unionByName(further)
    if further.isEmpty():
        return None if links.isEmpty() else roots
    return components(every)


def drop_near_duplicates(docs: DataFrame, tables: int = 8, radius: int = 3, size: int = 64, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, dense: int = DENSE) -> DataFrame:
    """One document of each component, with all its columns."""
    # the table's own columns are held apart, so that none clashes
    numbered = stored(docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("held"), F.monotonically_increasing_id().alias("row")), "numbered")
    texts = numbered.select("row", F.col("held")[id_col].cast("long").alias("doc_id"), F.coalesce(F.col("held")[text_col], F.lit("")).alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = as_bytes(batch.column("text"))
            own = word_hashes(texts)
            prints = majorities(list(map(_distinct, own)), tables).view(np.int64)
            sets = [shingle_hashes(x, width) for x in own]
            columns = {"row": batch.column("row"), "doc_id": batch.column("doc_id"), "fps": pa.array(prints.tolist(), pa.list_(pa.int64())), "size": pa.array(list(map(len, sets)), pa.int64()), "digest": pa.array(list(map(_digest_of, sets)), pa.binary()), "text_hash": pa.array([xxhash.xxh64_intdigest(x, SEED) >> 1 for x in texts], pa.int64())}
            yield pa.RecordBatch.from_pydict(columns)

    prints = stored(texts.mapInArrow(hashed, "row long, doc_id long, fps array<long>, size long, digest binary, text_hash long"), "prints")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash", "row")).alias("best")
    # texts with equal sets may have other words' counts, so the fingerprints are those of one row
    nodes = stored(prints.groupBy("digest").agg(best, F.min_by(F.struct("fps", "size"), "row").alias("own"), F.min("row").alias("node")).select("node", "best", "own.*"), "nodes")
    roots = confirmed_roots(nodes.where("size > 0"), texts, radius, size, limit, width, threshold, dense)
    if roots is not None:
        nodes = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("node")).agg(F.min("best").alias("best"))
    dropped = stored(prints.select("row").join(nodes.select("best.row"), "row", "left_anti"), "dropped")
    kept, others = sieved(numbered, dropped, "row")
    return kept.unionByName(others.join(dropped, "row", "left_anti")).select("held.*")
