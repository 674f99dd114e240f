"""SimHash near-duplicates with BK-trees.

Fingerprints: a bit is set if it is set in more than half of the hashes of the text's features (no
feature: zero).  ``simhash_components`` hashes all 3-word shingles, repeats included, with XXH64
and seed 42.  Documents with the same fingerprint are one node.

Shards: two fingerprints that differ in at most ``radius`` bits agree on one of ``radius + 1`` ranges
that share out the 64 bits, so each is in one shard for each range: those that agree with it on
the range's first bits, as many bits as make shards of about ``size`` members.  A shard that turns
out to have more than ``limit`` members goes on by the whole range, then by further ranges in other
orders; what is still large after eight rounds agrees on nearly all bits and is searched as it is.

Each shard is searched with a BK-tree: children are keyed by their integer Hamming distance to
their parent, and a search follows only the edges whose key is within the radius of the distance
to the node.  A shard's tree is built where its members meet.  To broadcast the trees, the driver
would have to gather the fingerprints of all documents, which grow with the corpus.  Only the links
that join two so far separate sets of a shard are given out (a spanning forest), fewer than the
shard has members, so groups of copies never become all their pairs.

Components: large-star / small-star contraction over the links, as in ``operators.components``.

Cases: null text counts as empty; documents without words share the fingerprint zero and are
linked like any other; rows without an id take part, and component_id is null only where no
member has an id; repeated rows give repeated rows; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce
from itertools import repeat
from math import ceil, log2
from random import Random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.texts import as_bytes, id_and_text, sliced
from lodeframe.operators.components import components
from lodeframe.storage import stored

SEED = 42
#: XXH64's multipliers, and which bytes are white space.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Hashes that are counted at once.
LANES = 1 << 17
#: Rounds in which large shards are dealt out again.
LEVELS = 8


def shingles(text: bytes, width: int) -> list[bytes]:
    """All ``width``-word shingles, repeats included (fewer words: all of them; none: none)."""
    words = text.lower().split()
    if len(words) > width:
        return list(map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)))
    return [b" ".join(words)] if words else []


def distinct_words(text: bytes) -> list[bytes]:
    return list(set(text.lower().split()))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """The XXH64 of each text's words, lower-cased, in their order: step by step for all words at once, as a call for
    each word takes four times as long; words of 32 bytes and more, which have further steps, are few and take the call."""
    joined = b" ".join(texts).lower() + b" " * 8
    flat = np.frombuffer(joined, np.uint8)
    edges = np.flatnonzero(np.diff(np.append(True, SPACES[flat])))  # the buffer ends in spaces, so each word has both
    starts, n = edges[::2], (edges[1::2] - edges[::2]).astype(np.uint64)
    eight, four = (np.ndarray(len(flat) - 7, kind, joined, strides=(1,)) for kind in ("<u8", "<u4"))
    h = n + (P5 + np.uint64(SEED))
    for k in range(3):
        own = np.flatnonzero(n >= 8 * (k + 1))
        h[own] = _turned(h[own] ^ (_turned(eight[starts[own] + 8 * k] * P2, 31) * P1), 27) * P1 + P4
    own = np.flatnonzero(n & np.uint64(4))
    h[own] = _turned(h[own] ^ (four[starts[own] + (n[own] & ~np.uint64(7)).astype(np.int64)] * P1), 23) * P2 + P3
    for k in range(3):
        own = np.flatnonzero(n & np.uint64(3) > k)
        h[own] = _turned(h[own] ^ (flat[starts[own] + (n[own] & ~np.uint64(3)).astype(np.int64) + k] * P5), 11) * P1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(n >= 32).tolist():
        h[i] = xxhash.xxh64_intdigest(joined[starts[i] : starts[i] + int(n[i])], SEED)
    ends = np.cumsum([len(text) + 1 for text in texts[:-1]])
    return np.split(h, np.searchsorted(starts, ends)) if texts else []


def fingerprints(texts: list[bytes], features: Callable[[bytes], list[bytes]], tables: int = 1) -> np.ndarray:
    """The 64-bit fingerprints of each text, one column per table.  The first table takes the
    features' XXH64, the others mix it anew."""
    return majorities([np.fromiter(map(xxhash.xxh64_intdigest, features(text), repeat(SEED)), np.uint64) for text in texts], tables)


def majorities(hashes: list[np.ndarray], tables: int = 1) -> np.ndarray:
    """The fingerprints of lists of features' hashes."""
    out = np.zeros((len(hashes), tables), np.uint64)
    start = 0
    while start < len(hashes):  # as many lists at a time as fit the lanes
        end, n = start, 0
        while end < len(hashes) and (end == start or n + len(hashes[end]) <= LANES):
            n += len(hashes[end])
            end += 1
        out[start:end] = _majority(hashes[start:end], tables)
        start = end
    return out


def _mixed(hashes: np.ndarray, table: int) -> np.ndarray:
    if not table:
        return hashes
    z = hashes + np.uint64(table * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _majority(hashes: list[np.ndarray], tables: int) -> np.ndarray:
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    out = np.zeros((len(hashes), tables), np.uint64)
    classes = np.frexp(sizes)[1]
    for c in np.unique(classes[sizes > 0]).tolist():  # texts of about one length are counted side by side
        own = np.flatnonzero(classes == c)
        flat = np.concatenate([hashes[i] for i in own.tolist()])
        inside = np.arange(int(sizes[own].max())) < sizes[own, None]
        laid = np.zeros((inside.shape[1], tables, len(own)), np.uint64)
        for k in range(tables):
            one = np.zeros(inside.shape, np.uint64)
            one[inside] = _mixed(flat, k)
            laid[:, k] = one.T
        out[own] = _exceeding(_planes(laid.reshape(len(laid), -1)), np.tile(sizes[own] // 2, tables)).reshape(tables, -1).T
    return out


def _planes(rows: np.ndarray) -> list[np.ndarray]:
    """How often each bit is set down the first axis, as binary numbers: the k-th array has their k-th digits."""
    planes = []
    while len(rows):
        carried = []
        while len(rows) > 1:
            n = max(1, len(rows) // 3)
            a, b = rows[:n], rows[n : 2 * n]
            either = a ^ b
            if len(rows) == 2:
                carried.append(a & b)
                rows = either
            else:  # a full adder: three digits to one, and one of the next place
                c = rows[2 * n : 3 * n]
                carried.append((a & b) | (c & either))
                rows = np.concatenate([either ^ c, rows[3 * n :]])
        planes.append(rows[0])
        rows = np.concatenate(carried) if carried else rows[:0]
    return planes


def _exceeding(planes: list[np.ndarray], least: np.ndarray) -> np.ndarray:
    """The bits whose counts are over ``least``."""
    over, equal = np.zeros(len(least), np.uint64), np.full(len(least), ~np.uint64(0))
    digits = max(len(planes), int(least.max()).bit_length())
    for k in range(digits - 1, -1, -1):
        own = planes[k] if k < len(planes) else np.zeros(len(least), np.uint64)
        other = np.where(least >> k & 1, ~np.uint64(0), np.uint64(0))
        over |= equal & own & ~other
        equal &= ~(own ^ other)
    return over


class BKTree:
    """A tree over integers; ``children[node][distance]`` is the child at that Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new = len(self.values) - 1
        node = 0
        while node != new:
            distance = (self.values[node] ^ value).bit_count()
            node = self.children[node].setdefault(distance, new)

    def within(self, value: int, radius: int) -> Iterator[int]:
        """The nodes whose values differ from ``value`` in at most ``radius`` bits."""
        todo = [0] if self.values else []
        while todo:
            node = todo.pop()
            distance = (self.values[node] ^ value).bit_count()
            if distance <= radius:
                yield node
            children = self.children[node]
            if len(children) > 2 * radius:
                for key in range(max(0, distance - radius), distance + radius + 1):
                    if key in children:
                        todo.append(children[key])
            else:
                todo.extend(child for key, child in children.items() if abs(key - distance) <= radius)


def forest(values: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links (i, j) between ``values`` that join them as all links within the radius do."""
    tree, parent, sets = BKTree(), list(range(len(values))), 0

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, value in enumerate(values):
        sets += 1
        for j in tree.within(value, radius):
            a, b = root(i), root(j)
            if a != b:
                parent[a] = b
                sets -= 1
                yield i, j
                if sets == 1:
                    break
        tree.add(value)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _ranges(bits: list[int], parts: int) -> list[int]:
    """The given bits cut into ``parts`` masks."""
    return [sum(1 << b for b in bits[len(bits) * k // parts : len(bits) * (k + 1) // parts]) for k in range(parts)]


def shard_masks(radius: int, n: int, size: int) -> dict[int, int]:
    """Of each of ``radius + 1`` ranges that share out the 64 bits: the mask of its first bits, so
    many that ``n`` fingerprints make shards of about ``size``, and the mask of all of it.

    >>> sorted(shard_masks(1, 4096, 512).items()) == [(0b111, 2**32 - 1), (0b111 << 32, 2**64 - 2**32)]
    True
    """
    bits, out = max(0, ceil(log2(max(1, n / size)))), {}
    for k in range(radius + 1):
        own = list(range(64 * k // (radius + 1), 64 * (k + 1) // (radius + 1)))
        out[sum(1 << b for b in own[:bits])] = sum(1 << b for b in own)
    return out


def level_masks(level: int, radius: int) -> list[int]:
    """radius + 1 ranges that share out the 64 bits in an order that changes with the level: two
    fingerprints that differ in ``radius`` bits at most agree on one of them."""
    bits = list(range(64))
    Random(level).shuffle(bits)
    return _ranges(bits, radius + 1)


def in_shards(rows: DataFrame, n: int, radius: int, size: int, limit: int, known: list[DataFrame] | None = None, apart: list[DataFrame] | None = None) -> DataFrame:
    """``rows`` (t, fp and further columns) with the shards (t, mask, bits) that each is in; ``n`` is
    the number of rows of a table ``t``.  ``known`` takes the keys of the large shards of each level;
    given again with the same fingerprints, it saves counting them anew.

    Further bits don't split what shares one fingerprint.  Where ``apart`` is given, it takes the rows of shards of more
    than a quarter of ``limit`` rows of one fingerprint instead, and the caller compares those."""
    known = [] if known is None else known
    masks, keys = shard_masks(radius, n, size), ["t", "mask", "bits"]
    wholes = F.create_map(*(F.lit(_signed(x)) for pair in masks.items() for x in pair))
    columns = [c for c in rows.columns if c not in keys]
    bits = F.col("fp").bitwiseAND(F.col("mask"))
    dealt, found = rows.select("*", F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("mask")).withColumn("bits", bits), []
    for level in range(LEVELS + 1):
        if level == len(known):
            sizes = dealt.groupBy(*keys).agg(F.count("*").alias("n"), (F.min("fp") == F.max("fp")).alias("one"))
            known.append(stored(sizes.where(F.col("n") > F.when(F.col("one"), limit // 4).otherwise(limit)).select(*keys, "one"), "large"))
        large = known[level].where("NOT one").drop("one")
        if apart is not None and not (same := known[level].where("one").drop("one")).isEmpty():
            apart.append(stored(dealt.join(same, keys, "left_semi").select("t", *columns), "apart"))
            dealt = dealt.join(same, keys, "left_anti")
        if level == LEVELS or large.isEmpty():
            found.append(dealt)
            break
        found.append(dealt.join(large, keys, "left_anti"))
        hot = dealt.join(large, keys, "left_semi")
        if level == 0 and all(first not in (0, whole) for first, whole in masks.items()):
            finer = hot.withColumn("mask", F.try_element_at(wholes, "mask"))
        else:
            more = F.explode(F.array(*(F.lit(_signed(m)) for m in level_masks(level, radius))))
            finer = hot.select("t", *columns, "mask", more.alias("more")).withColumn("mask", F.col("mask").bitwiseOR(F.col("more"))).drop("more")
        dealt = stored(finer.withColumn("bits", bits).select(*keys, *columns).distinct(), "finer")
    return reduce(DataFrame.unionByName, (x.select(*keys, *columns) for x in found))


def in_turn(shards: DataFrame) -> DataFrame:
    """Each shard's rows one after another, by fingerprint."""
    keys = ["t", "mask", "bits"]
    return shards.repartition(*keys).sortWithinPartitions(*keys, "fp")


def links(nodes: DataFrame, radius: int = 2, size: int = 128, limit: int = 1024) -> DataFrame:
    """Links (a, b) that join the nodes (node, fp: its fingerprint as a signed long, no two the same)
    as all links within the radius do."""
    shards = in_shards(nodes.select(F.lit(0).alias("t"), "fp", "node"), nodes.count(), radius, size, limit)
    return in_turn(shards).mapInArrow(_searcher(radius), "a long, b long").distinct()


def _searcher(radius: int):
    """Searches shards whose rows come one after another."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fps, nodes, out = None, [], [], []
        for batch in batches:
            for t, mask, bits, fp, node in zip(*(batch.column(c).to_pylist() for c in ("t", "mask", "bits", "fp", "node")), strict=True):
                if (t, mask, bits) != key:
                    out.extend((nodes[i], nodes[j]) for i, j in forest(fps, radius))
                    key, fps, nodes = (t, mask, bits), [], []
                fps.append(fp & 0xFFFFFFFFFFFFFFFF)
                nodes.append(node)
            if out:
                yield to_batch(out)
                out = []
        out.extend((nodes[i], nodes[j]) for i, j in forest(fps, radius))
        if out:
            yield to_batch(out)

    def to_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs, strict=True)], ["a", "b"])

    return search


def fingerprinted(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document: row (a number of its own), doc_id, fp (as a signed long)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            own = fingerprints(as_bytes(batch.column("text")), partial(shingles, width=width)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own[:, 0])], ["doc_id", "fp"])

    prints = id_and_text(docs, id_col, text_col).mapInArrow(hashed, "doc_id long, fp long")
    return stored(prints.withColumn("row", F.monotonically_increasing_id()), "prints")


def _classes(prints: DataFrame, radius: int, size: int, limit: int) -> DataFrame:
    """(fp, component_id) of all distinct fingerprints."""
    nodes = stored(prints.groupBy("fp").agg(F.min("row").alias("node"), F.min("doc_id").alias("first_id")), "nodes")
    roots = components(links(nodes, radius, size, limit))
    rooted = stored(nodes.join(roots, "node", "left").select("fp", "first_id", F.coalesce("root", "node").alias("root")), "rooted")
    # stored, so that the join deals both sides out itself and can split a component of very many nodes
    least = stored(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    return rooted.join(least, "root").select("fp", "component_id")


def simhash_components(docs: DataFrame, width: int = 3, radius: int = 2, size: int = 128, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    prints = fingerprinted(docs, width, id_col, text_col)
    classes = _classes(prints, radius, size, limit)
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
