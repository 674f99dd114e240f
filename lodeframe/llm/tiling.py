"""Benchmark decontamination by greedy string tiling.

Words: lower case, ASCII punctuation removed.  A running (Karp-Rabin) hash over ``min_match``
words gives the seeds that a document shares with a benchmark item; equal hashes are compared
word by word.  Seeds next to each other on a diagonal make up a match; the longest match whose
words are unmarked on both sides is marked as a tile, matches that overlap it are cut down to
what is unmarked, and so on until none of ``min_match`` words is left.  A document is
contaminated by an item if the tiles cover at least ``coverage`` of the item's words, in whatever
order they stand.

An item is looked up by its seeds that few places share.  Of those that more than ``HOT`` places
share it leaves out as many, the most common first, as together cover too few of its words, which
loses nothing: a document that reaches ``coverage`` has one of the others, too.  All seeds of a
pair are gathered only once one was found.

The benchmark is a stated query set.  Its size is measured first; it is taken in blocks of at most
about ``block_bytes`` and each block is broadcast, so what is sent is bounded and a benchmark of
any size takes more passes, not more memory.  A worker makes a block's index once.

Cases: bytes that aren't UTF-8 count as the replacement character; null texts count as empty; items of fewer than ``min_match`` words have no tile and match
nothing; rows that repeat a document give repeated rows, items that are repeated (or lack an id)
each match; empty tables give no matches; other columns are ignored by ``contaminated`` and
returned untouched by ``drop_contaminated``.
"""

from __future__ import annotations

import heapq
import string
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import chain, count, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.texts import as_bytes, id_and_text, sliced
from lodeframe.storage import stored

SCHEMA = "doc_id long, item_id long, n_tiles long, matched_words long, item_words long, coverage double"
PUNCTUATION = string.punctuation.encode()
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Seeds that more places share are looked up only where an item needs them.
HOT = 64


def words(text: bytes) -> list[bytes]:
    return text.decode(errors="replace").lower().encode().translate(None, PUNCTUATION).split()


def running_hash(ids: np.ndarray, width: int) -> np.ndarray:
    """The hash of each ``width`` ids in a row, modulo 2**64."""
    n = max(0, len(ids) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * BASE + ids[k : k + n].astype(np.uint64)
    return out


class Index:
    """The seeds of a block of benchmark items."""

    def __init__(self, items: list[tuple[int | None, str | None]], min_match: int, coverage: float):
        self.min_match, self.coverage = min_match, coverage
        self.numbers: dict[bytes, int] = defaultdict(count(1).__next__)
        self.item_ids = [i for i, _ in items]
        self.items = [np.fromiter((self.numbers[w] for w in words((t or "").encode())), np.int64) for _, t in items]
        self.numbers = dict(self.numbers)
        self.hashes = [running_hash(x, min_match) for x in self.items]
        item = np.repeat(np.arange(len(items)), [len(h) for h in self.hashes])
        flat = np.concatenate(self.hashes) if self.hashes else np.zeros(0, np.uint64)
        _, kind, shared = np.unique(flat, return_inverse=True, return_counts=True)
        look = self._looked_up(shared[kind]) if len(flat) else np.zeros(0, bool)
        flat, item = flat[look], item[look]
        order = np.argsort(flat, kind="stable")
        self.seeds, self.item = flat[order], item[order]

    def _looked_up(self, shared: np.ndarray) -> np.ndarray:
        """Whether each seed of the items in a row is looked up; ``shared``: how many places have it."""
        look, start = np.ones(len(shared), bool), 0
        for own, hashes in zip(self.items, self.hashes, strict=True):
            here = shared[start : start + len(hashes)]
            if len(here) and here.max() > HOT:
                covered = np.zeros(len(own), bool)
                for place in sorted(np.flatnonzero(here > HOT).tolist(), key=lambda k: (-here[k], k)):
                    covered[place : place + self.min_match] = True
                    if covered.sum() >= self.coverage * len(own):
                        break
                    look[start + place] = False
            start += len(hashes)
        return look

    def matches(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, tiles, matched words, item's words) of all pairs that reach ``coverage``."""
        if not len(self.seeds):
            return
        cut = [words(t) for t in texts]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        ids = np.fromiter(map(self.numbers.get, chain.from_iterable(cut), repeat(0)), np.int64, int(sizes.sum()))
        k = self.min_match
        n = len(ids) - k + 1
        if n <= 0:
            return
        starts = np.cumsum(sizes) - sizes
        text_of = np.repeat(np.arange(len(texts)), sizes)
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        whole = np.flatnonzero((unknown[k:] == unknown[:-k]) & (text_of[:n] == text_of[k - 1 :]))
        hashed, text = running_hash(ids, k)[whole], text_of[whole]
        at = np.append(np.searchsorted(text, np.arange(len(texts))), len(text))
        low = np.searchsorted(self.seeds, hashed, side="left")
        hit = self.seeds[np.minimum(low, len(self.seeds) - 1)] == hashed
        for t in np.unique(text[hit]).tolist():
            own = slice(at[t], at[t + 1])
            order = np.argsort(hashed[own], kind="stable")
            here, place = hashed[own][order], (whole[own] - starts[t])[order]
            first = np.unique(low[own][hit[own]])
            last = np.searchsorted(self.seeds, self.seeds[first], side="right")
            found = np.unique(np.concatenate([self.item[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)]))
            words_here = ids[starts[t] : starts[t] + sizes[t]]
            for i in found.tolist():
                size, seeds = len(self.items[i]), self.hashes[i]
                left = np.searchsorted(here, seeds, side="left")
                many = np.searchsorted(here, seeds, side="right") - left
                if np.count_nonzero(many) * k < self.coverage * size:
                    continue  # all seeds together can't cover enough
                q = np.repeat(np.arange(len(seeds)), many)
                p = place[np.repeat(left - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
                along = np.lexsort((p, p - q))
                tiles = greedy_tiles(words_here, self.items[i], p[along], q[along], k)
                matched = sum(n for _, _, n in tiles)
                if matched >= self.coverage * size:
                    yield t, i, len(tiles), matched, size


#: Indexes that this worker made, by the broadcast's name; a few, as a task uses one.
_made: dict[str, Index] = {}


def _index(name: str, sent: Broadcast) -> Index:
    if name not in _made:
        if len(_made) > 1:
            _made.clear()
        _made[name] = Index(*sent.value)
    return _made[name]


def greedy_tiles(text: np.ndarray, item: np.ndarray, at: np.ndarray, place: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Tiles (start in text, start in item, words), longest first, then leftmost in the item and
    in the text.  ``at`` and ``place`` are the seeds, in order along their diagonals."""
    true = np.ones(len(at), bool)
    for k in range(min_match):
        true &= text[at + k] == item[place + k]
    at, place = at[true], place[true]
    if not len(at):
        return []
    first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(place) != 1)]))
    length = np.diff(np.append(first, len(at))) + min_match - 1
    heap = [(-n, q, p) for n, p, q in zip(length.tolist(), at[first].tolist(), place[first].tolist(), strict=True)]
    heapq.heapify(heap)
    in_text, in_item, tiles = set(), bytearray(len(item)), []
    while heap:
        n, q, p = heapq.heappop(heap)
        n = -n
        free = [not in_item[q + k] and p + k not in in_text for k in range(n)]
        if all(free):
            tiles.append((p, q, n))
            in_text.update(range(p, p + n))
            in_item[q : q + n] = b"\1" * n
            if not in_item.count(0):
                break
            continue
        k = 0
        while k < n:  # what is still unmarked goes back
            end = k
            while end < n and free[end]:
                end += 1
            if end - k >= min_match:
                heapq.heappush(heap, (k - end, q + k, p + k))
            k = end + 1
    return tiles


def item_blocks(benchmark: DataFrame, block_bytes: int, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, str | None]]]:
    """The benchmark in blocks of about ``block_bytes`` at most, by a measured size."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = -(-2 * total // block_bytes)
    for k in range(max(1, n)):
        part = items if n <= 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield sorted(((r["item_id"], r["text"]) for r in part.collect()), key=str)


def _by_block(rows: DataFrame, benchmark: DataFrame, make: Callable[[Callable[[], Index]], Callable], schema, block_bytes: int, id_col: str, text_col: str, setting: tuple, chained: bool) -> list[DataFrame]:
    """What ``make`` makes of ``rows`` with each block's index, or of what the block before left."""
    spark, out, blocks = rows.sparkSession, [], item_blocks(benchmark, block_bytes, id_col, text_col)
    items = next(blocks)
    while items is not None:
        sent, name, more = spark.sparkContext.broadcast((items, *setting)), uuid.uuid4().hex, next(blocks, None)
        done = rows.mapInArrow(make(lambda name=name, sent=sent: _index(name, sent)), schema)
        if more is not None or out:  # of several blocks one is held at a time
            done = stored(done, "tiled")
            sent.destroy()
        out.append(done)
        rows, items = (done if chained else rows), more
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, coverage: float = 0.6, block_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item whose tiles cover at least ``coverage`` of the item."""

    def make(index: Callable[[], Index]):
        def match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = index()
            for batch in sliced(batches):
                ids = batch.column("doc_id").to_pylist()
                got = [(ids[t], own.item_ids[i], n, m, size, m / size) for t, i, n, m, size in own.matches(as_bytes(batch.column("text")))]
                if got:
                    kinds = [pa.int64()] * 5 + [pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*got, strict=True), kinds, strict=True)], ["doc_id", "item_id", "n_tiles", "matched_words", "item_words", "coverage"])

        return match

    rows = id_and_text(docs, id_col, text_col)
    return reduce(DataFrame.unionByName, _by_block(rows, benchmark, make, SCHEMA, block_bytes, item_id_col, item_text_col, (min_match, coverage), False))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, coverage: float = 0.6, block_bytes: int = 32 << 20, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that no item contaminates, with all their columns."""

    def make(index: Callable[[], Index]):
        def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = index()
            for batch in sliced(batches, text_col):
                clean = np.ones(batch.num_rows, bool)
                for t, *_ in own.matches(as_bytes(batch.column(text_col))):
                    clean[t] = False
                yield batch.filter(pa.array(clean))

        return keep

    return _by_block(docs, benchmark, make, docs.schema, block_bytes, item_id_col, item_text_col, (min_match, coverage), True)[-1]
