"""Repeated passages by recompression (Jeż, "Recompression: a simple and powerful technique for word
equations", 2013).

A text's words are symbols.  A level replaces each maximal run of one symbol by a new symbol, then
each pair (left, right) by a new one, where a symbol counts as left or right by a bit of its name.
A name is a hash of what the symbol stands for, so all tasks give equal runs and pairs the same
name without a dictionary.  Equal passages thus get equal symbols inside; only near their ends do the
neighbours interfere.  Each symbol carries the words that it depends on: if they all lie inside a
repeated passage, the symbol occurs there again.

Spark counts names over the whole corpus in three rounds, and a text leaves once none of its windows
(``window`` words in a row) is open:

1. Symbols that just reached ``SHORT`` words.  A name met once rules out every window that holds
   all words on which it depends.
2. Of the rest, all symbols of a window's length or more.  A name met again (with the same fingerprint of
   its words, as a check) proves all windows inside its places repeated.
3. Windows that are still open are counted by a fingerprint of 96 bits, and with them the windows in one
   place of each symbol of the second round, so that a copy cut elsewhere finds its partner.

No round decides by anything else than the count of equal windows, so the result is exact but for equal
fingerprints of different windows (96 bits).  A block of texts (16 MB) asks for each name once, so
the most common name is a small key, and what a task holds is a block.

Windows count in the input: one that starts anywhere else, in the same text too, is repeated and all its
words are removed.  Rows are texts of their own, whatever their id.

Cases: null text counts as empty (no words); texts shorter than a window are kept whole; a repeated row
repeats all its windows; rows without an id take part; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.llm.blocks import scanned
from lodeframe.llm.texts import as_bytes, id_and_text, sliced
from lodeframe.storage import publish, shared_path

#: Words that a symbol of the first round has at least.
SHORT = 5
#: Levels of the first round; a symbol that is shorter still isn't counted.
SHORT_LEVELS = 16
#: A name has so many bits, each of which decides one level.
LEVELS = 64
#: Bytes of text in a block, and of texts that are taken at a time.
BLOCK_BYTES, SLICE_BYTES = 16 << 20, 2 << 20
#: Rows of a batch that is given out.
LANES = 200_000
#: Odd multipliers of 64 bits.
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * M3
    x = (x ^ (x >> np.uint64(29))) * M2
    return x ^ (x >> np.uint64(32))


@dataclass
class Symbols:
    """Symbols in their texts' order: the words [start, end) that each stands for, the words [low, high) that
    its name and place depend on (a text's first word - 1 and its last word + 1 stand for its ends),
    and whether it is its text's first."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray

    @classmethod
    def of_words(cls, words: np.ndarray, offsets: np.ndarray) -> Symbols:
        at = np.arange(len(words))
        first = np.zeros(len(words), bool)
        first[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        return cls(words, at, at + 1, at, at + 1, first)

    def __len__(self) -> int:
        return len(self.name)

    def taken(self, which: np.ndarray) -> Symbols:
        return Symbols(*(getattr(self, c)[which] for c in self.__dataclass_fields__))

    def sizes(self) -> np.ndarray:
        return self.end - self.start


def _runs(x: Symbols, words: np.ndarray) -> tuple[Symbols, np.ndarray, np.ndarray]:
    """Each maximal run as one symbol; which symbols are new, and the size of what they are made of."""
    begins = x.first | np.concatenate([[True], x.name[1:] != x.name[:-1]])
    at = np.flatnonzero(begins)
    n = np.diff(np.append(at, len(x)))
    size = x.sizes()[at]
    if len(at) < len(x):
        name = np.where(n > 1, _mixed(x.name[at] * M1 + n.astype(np.uint64)), x.name[at])
        low, high = np.minimum.reduceat(x.low, at), np.maximum.reduceat(x.high, at)
        x = Symbols(name, x.start[at], x.end[at + n - 1], low, high, x.first[at])
    # a run is maximal if the symbols beside it differ: mostly the next word alone says so
    last = np.append(x.first[1:], True)
    left = x.first | (words[x.start - 1] != words[x.end - 1])
    right = last | (words[np.minimum(x.end, len(words) - 1)] != words[x.start])
    low = np.minimum(x.low, np.where(left, x.start - 1, np.concatenate([x.low[:1], x.low[:-1]])))
    high = np.maximum(x.high, np.where(right, x.end + 1, np.append(x.high[1:], x.high[-1:])))
    return Symbols(x.name, x.start, x.end, low, high, x.first), n > 1, size


def _pairs(x: Symbols, level: int) -> tuple[Symbols, np.ndarray, np.ndarray]:
    """Each pair of a left and a right symbol as one; which are new, and the larger size of the two."""
    right = ((x.name >> np.uint64(level)) & np.uint64(1)).astype(bool)
    follows = np.append(~x.first[1:], False)
    made = ~right & follows & np.append(right[1:], False)
    at = np.flatnonzero(made)
    low, high = x.low.copy(), x.high.copy()
    # one that stays alone depends on the neighbour that it might have gone with, or on the text's end
    alone = np.flatnonzero(~right & ~made)
    after = np.minimum(alone + 1, len(x) - 1)
    has = follows[alone]
    low[alone] = np.where(has, np.minimum(x.low[alone], x.low[after]), x.low[alone])
    high[alone] = np.maximum(x.high[alone], np.where(has, x.high[after], x.end[alone] + 1))
    alone = np.flatnonzero(right & ~np.concatenate([[False], made[:-1]]))
    before = np.maximum(alone - 1, 0)
    has = ~x.first[alone]
    low[alone] = np.minimum(x.low[alone], np.where(has, x.low[before], x.start[alone] - 1))
    high[alone] = np.where(has, np.maximum(x.high[alone], x.high[before]), x.high[alone])
    name, end, larger = x.name.copy(), x.end.copy(), x.sizes()
    name[at] = _mixed(x.name[at] * M1 ^ _mixed(x.name[at + 1] + M2))
    end[at] = x.end[at + 1]
    larger[at] = np.maximum(larger[at], larger[at + 1])
    low[at], high[at] = np.minimum(x.low[at], x.low[at + 1]), np.maximum(x.high[at], x.high[at + 1])
    stays = np.ones(len(x), bool)
    stays[at + 1] = False
    return Symbols(name, x.start, end, low, high, x.first).taken(stays), made[stays], larger[stays]


def levels(words: np.ndarray, offsets: np.ndarray, limit: int = LEVELS) -> Iterator[tuple[Symbols, np.ndarray]]:
    """The new symbols of each run step and pair step, and the size of the largest of those that each is made of."""
    x, texts = Symbols.of_words(words, offsets), int((offsets[1:] > offsets[:-1]).sum())
    for level in range(limit):
        if len(x) == texts:
            return
        x, new, size = _runs(x, words)
        if new.any():
            yield x.taken(new), size[new]
        x, new, size = _pairs(x, level)
        if new.any():
            yield x.taken(new), size[new]


def _joined(parts: list[Symbols]) -> Symbols:
    parts = parts or [Symbols.of_words(np.zeros(0, np.uint64), np.zeros(1, np.int64))]
    return Symbols(*(np.concatenate([getattr(p, c) for p in parts]) for c in Symbols.__dataclass_fields__))


def short_symbols(words: np.ndarray, offsets: np.ndarray) -> Symbols:
    """The symbols of ``SHORT`` words or more that are made of shorter ones."""
    return _joined([x.taken((x.sizes() >= SHORT) & (size < SHORT)) for x, size in levels(words, offsets, SHORT_LEVELS)])


def long_symbols(words: np.ndarray, offsets: np.ndarray, least: int) -> Symbols:
    """All symbols of ``least`` words or more."""
    return _joined([x.taken(x.sizes() >= least) for x, _ in levels(words, offsets)])


class Fingerprints:
    """Karp-Rabin fingerprints of 96 bits of any stretch of words, by sums of words times powers."""

    def __init__(self, words: np.ndarray):
        self.lanes = []
        for base, values in ((M1, words), (M2, _mixed(words + M3))):
            powers = np.ones(len(words) + 1, np.uint64)
            np.multiply.accumulate(np.full(len(words), base, np.uint64), out=powers[1:])
            sums = np.zeros(len(words) + 1, np.uint64)
            np.cumsum(values * powers[:-1], out=sums[1:])
            inverse = np.ones(len(words) + 1, np.uint64)
            np.multiply.accumulate(np.full(len(words), pow(int(base), -1, 1 << 64), np.uint64), out=inverse[1:])
            self.lanes.append((sums, inverse))

    def of(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = (_mixed((sums[end] - sums[start]) * inverse[start]) for sums, inverse in self.lanes)
        return a, b >> np.uint64(32)


# ------------------------------------------------------------------------------------------ blocks


class _Block:
    """The texts of a block: numbers of their words in the order of the block's distinct words."""

    def __init__(self):
        self.numbers: dict[bytes, int] = defaultdict(count().__next__)
        self.ids: list[np.ndarray] = []
        self.doc_ids: list[pa.Array] = []
        self.n_bytes = 0

    def add(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and offsets of the batch's texts."""
        texts = as_bytes(batch.column("text"))
        number = self.numbers.__getitem__
        own = [np.fromiter(map(number, words), np.int32, len(words)) for words in map(bytes.split, texts)]
        self.ids.extend(own)
        self.doc_ids.append(pa.concat_arrays([batch.column("doc_id")]))
        self.n_bytes += sum(map(len, texts))
        return np.concatenate([np.zeros(0, np.int32), *own]), _offsets(np.fromiter(map(len, own), np.int64, len(own)))

    def write(self, folder: str, number: int, own: str) -> None:
        offsets = _offsets(np.fromiter(map(len, self.ids), np.int64, len(self.ids)))
        docs = pa.RecordBatch.from_pydict({"doc_id": pa.chunked_array(self.doc_ids).combine_chunks(), "ids": pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *self.ids])))})
        words = pa.RecordBatch.from_pydict({"word": pa.array(list(self.numbers), pa.large_binary())})
        _write(f"{folder}/{number}-docs", own, docs)
        _write(f"{folder}/{number}-words", own, words)


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _write(path: str, own: str, batch: pa.RecordBatch) -> None:
    fs, root = pafs.FileSystem.from_uri(path)
    fs.create_dir(root.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(root + own) as sink, pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    publish(fs, root + own, root + ".arrow")


def _read(path: str) -> pa.RecordBatch:
    fs, root = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(root + ".arrow") as f:
        return pa.ipc.open_stream(f).read_next_batch()


def _attempt() -> str:
    return f".attempt-{TaskContext.get().taskAttemptId()}"


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


class _Texts:
    """A block's texts read back."""

    def __init__(self, folder: str, block: int):
        docs = _read(f"{folder}/{block}-docs")
        self.doc_id, ids = docs.column("doc_id"), docs.column("ids")
        self.offsets, self.ids = np.asarray(ids.offsets), np.asarray(ids.values)
        self.vocabulary = _read(f"{folder}/{block}-words").column("word").to_pylist()
        self.hashes = _hashes(self.vocabulary)

    def slices(self) -> Iterator[tuple[int, int]]:
        """Texts [a, b) with about as many words as a slice of texts has bytes, divided by 6."""
        a, n = 0, len(self.offsets) - 1
        while a < n:
            b = max(a + 1, int(np.searchsorted(self.offsets, self.offsets[a] + SLICE_BYTES // 6, side="right")) - 1)
            yield a, b
            a = b

    def words(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        return self.hashes[self.ids[self.offsets[a] : self.offsets[b]]], self.offsets[a : b + 1] - self.offsets[a]


def _whole(offsets: np.ndarray, window: int) -> np.ndarray:
    """Of each word: whether a window starts there."""
    n = np.diff(offsets)
    at = np.arange(offsets[-1])
    return at + window <= np.repeat(offsets[1:], n)


def _covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Of n places: whether any [start, end) holds it."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.clip(starts, 0, n), 1)
    np.add.at(change, np.clip(ends, 0, n), -1)
    return np.cumsum(change[:-1]) > 0


def _open_windows(x: Symbols, offsets: np.ndarray, window: int, again: np.ndarray) -> np.ndarray:
    """Windows that no symbol of the first round rules out; ``again``: the sorted names met again."""
    once = (x.high - x.low <= window) & ~_among(x.name, again)
    ruled_out = _covered(x.high[once] - window, np.maximum(x.low[once] + 1, 0), int(offsets[-1]))
    return _whole(offsets, window) & ~ruled_out


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _rows(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(columns.values())))
    for k in range(0, n, LANES):
        yield pa.RecordBatch.from_pydict({c: pa.array(x[k : k + LANES]) for c, x in columns.items()})


def _counted(names: np.ndarray, checks: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (name, check) in order, their weights, and the number among them of each that was given."""
    order = np.lexsort((checks, names))
    a, b = names[order], checks[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    place = np.empty(len(a), np.int64)
    place[order] = np.cumsum(new) - 1
    n = np.bincount(place, weights, minlength=int(new.sum())).astype(np.int64)
    return a[new], b[new], n, place


REQUEST = "block long, local int, name long, checked long, n long"

def _requests(block: int, names: np.ndarray, checks: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each name and one that counts as met again and belongs to the block alone."""
    own = np.array([_mixed(np.array([block + 1], np.uint64) * M1)[0]], np.uint64)
    names, checks = np.concatenate([own, names]), np.concatenate([np.array([1 << 32], np.uint64), checks])
    yield from _rows({"block": np.full(len(names), block), "local": np.arange(-1, len(names) - 1, dtype=np.int32), "name": names.view(np.int64), "checked": checks.view(np.int64), "n": np.concatenate([[2], n])})


def _met_again(requests: DataFrame) -> DataFrame:
    """(block, local, home) of the names that the corpus has twice or more; home: whether the block is the least that
    has the name.  A name has at most one row for each block, which Spark sorts and may spill."""
    same = Window.partitionBy("name", "checked")
    total = requests.select("block", "local", F.sum("n").over(same).alias("total"), F.min("block").over(same).alias("least"))
    return total.where("total > 1").select("block", "local", (F.col("block") == F.col("least")).alias("home"))


def repeated_passages(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (the words that stay, joined by a space)."""
    source = scanned(id_and_text(docs, id_col, text_col))
    folder, parts = shared_path(docs.sparkSession, "recompression"), max(1, source.rdd.getNumPartitions())

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block, names = TaskContext.get().partitionId() << 12, _Block(), []
        hashes = np.zeros(0, np.uint64)
        for batch in sliced(batches, limit=SLICE_BYTES):
            known = len(hashes)
            ids, offsets = block.add(batch)
            hashes = np.concatenate([hashes, _hashes(list(block.numbers)[known:])])
            names.append(np.unique(short_symbols(hashes[ids], offsets).name, return_counts=True))
            if block.n_bytes >= BLOCK_BYTES:
                yield from closed(number, block, names)
                number, block, names, hashes = number + 1, _Block(), [], np.zeros(0, np.uint64)
        if block.ids:
            yield from closed(number, block, names)

    def closed(number: int, block: _Block, names: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        block.write(folder, number, _attempt())
        each, n = (np.concatenate([x[k] for x in names]) for k in (0, 1))
        name, check, n, _ = _counted(each, np.zeros(len(each), np.uint64), n)
        yield from _requests(number, name, check, n)

    def second(table: pa.Table) -> Iterator[pa.RecordBatch]:
        block = table.column("block")[0].as_py()
        local = np.sort(np.asarray(table.column("local")))
        texts, is_open, found, checks = _Texts(folder, block), [], [], []
        short = [short_symbols(*texts.words(a, b)) for a, b in texts.slices()]
        again = np.unique(np.concatenate([x.name for x in short]))[local[local >= 0]]
        for (a, b), symbols in zip(texts.slices(), short, strict=True):
            words, offsets = texts.words(a, b)
            own = _open_windows(symbols, offsets, window, again)
            is_open.append(own)
            live = np.flatnonzero(np.add.reduceat(np.append(own, False), offsets[:-1]) * (np.diff(offsets) > 0)) if len(offsets) > 1 else np.zeros(0, np.int64)
            if not len(live):
                continue
            at, parts = _places(offsets, live)
            x = long_symbols(words[at], parts, window)
            print_a, print_b = Fingerprints(words[at]).of(x.start, x.end)
            closed_before = np.concatenate([[0], np.cumsum(~own[at])])
            real = closed_before[x.end - window + 1] == closed_before[x.start]
            start = at[x.start[real]] + texts.offsets[a]
            found.append((x.name[real], start, start + x.sizes()[real]))
            checks.append((print_a ^ print_b)[real] >> np.uint64(32))
        name, start, end = (np.concatenate([np.zeros(0, kind), *(f[k] for f in found)]) for k, kind in enumerate((np.uint64, np.int64, np.int64)))
        names, check, n, place = _counted(name, np.concatenate([np.zeros(0, np.uint64), *checks]))
        bits = np.packbits(np.concatenate([np.zeros(0, bool), *is_open]))
        _write(f"{folder}/{block}-open", _attempt(), pa.RecordBatch.from_pydict({"bits": pa.array([bits.tobytes()], pa.large_binary())}))
        _write(f"{folder}/{block}-long", _attempt(), pa.RecordBatch.from_pydict({"start": pa.array(start), "end": pa.array(end), "place": pa.array(place)}))
        yield from _requests(block, names, check, n)

    def settled(texts: _Texts, block: int, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Windows proven repeated, and windows (2: proven; 1: open) whose fingerprints are to be counted."""
        n = int(texts.offsets[-1])
        bits = np.frombuffer(_read(f"{folder}/{block}-open").column("bits")[0].as_py(), np.uint8)
        weight = np.unpackbits(bits, count=n).astype(np.int8) if n else np.zeros(0, np.int8)
        long = _read(f"{folder}/{block}-long")
        start, end, place = (np.asarray(long.column(c)) for c in ("start", "end", "place"))
        local, home = np.asarray(table.column("local")), np.asarray(table.column("home"))
        here = dict(zip(local.tolist(), home.tolist(), strict=True))
        used = np.flatnonzero(_among(place, np.sort(local)))
        # each window goes by the largest repeated symbol that holds it; only its first place at home counts
        used = used[np.argsort((end - start)[used], kind="stable")]
        first_of: dict[int, int] = {}
        for k in used.tolist():
            p = int(place[k])
            first_of[p] = min(first_of.get(p, start[k]), start[k])
        for k in used.tolist():
            p = int(place[k])
            weight[start[k] : end[k] - window + 1] = 2 if here[p] and start[k] == first_of[p] else 3
        return weight >= 2, np.where(weight == 3, 0, weight)

    def counted(texts: _Texts, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of the windows to be counted and what ``_counted`` makes of them."""
        at, names, checks = [], [], []
        for a, b in texts.slices():
            base = texts.offsets[a]
            own = np.flatnonzero(weight[base : texts.offsets[b]])
            if len(own):
                name, check = Fingerprints(texts.words(a, b)[0]).of(own, own + window)
                at.append(own + base)
                names.append(name)
                checks.append(check)
        at = np.concatenate([np.zeros(0, np.int64), *at])
        return at, *_counted(np.concatenate([np.zeros(0, np.uint64), *names]), np.concatenate([np.zeros(0, np.uint64), *checks]), weight[at])

    def third(table: pa.Table) -> Iterator[pa.RecordBatch]:
        block = table.column("block")[0].as_py()
        texts = _Texts(folder, block)
        proven, weight = settled(texts, block, table)
        _, names, checks, n, _ = counted(texts, weight)
        bits = [np.packbits(x).tobytes() for x in (proven, weight == 1, weight == 2)]
        _write(f"{folder}/{block}-rest", _attempt(), pa.RecordBatch.from_pydict({"bits": pa.array(bits, pa.large_binary())}))
        yield from _requests(block, names, checks, n)

    def last(table: pa.Table) -> Iterator[pa.RecordBatch]:
        block = table.column("block")[0].as_py()
        texts = _Texts(folder, block)
        n = int(texts.offsets[-1])
        repeated, one, two = (np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) if n else np.zeros(0, bool) for x in _read(f"{folder}/{block}-rest").column("bits").to_pylist())
        at, _, _, _, place = counted(texts, one + 2 * two.astype(np.int8))
        repeated[at[_among(place, np.sort(np.asarray(table.column("local"))))]] = True
        starts = np.flatnonzero(repeated)
        removed = _covered(starts, starts + window, n)
        vocabulary = texts.vocabulary
        for a, b in texts.slices():
            kept, n_words, n_removed = [], [], []
            for k in range(a, b):
                i, j = texts.offsets[k], texts.offsets[k + 1]
                ids = texts.ids[i:j][~removed[i:j]]
                kept.append(b" ".join([vocabulary[w] for w in ids.tolist()]))
                n_words.append(int(j - i))
                n_removed.append(int(j - i) - len(ids))
            yield pa.RecordBatch.from_arrays([texts.doc_id.slice(a, b - a), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    def of_blocks(requests: DataFrame, step, schema: str) -> DataFrame:
        def apply(table: pa.Table) -> pa.Table:
            return pa.Table.from_batches(step(table))

        # dealt out by their number, not their size: a block's few rows stand for much work
        return _met_again(requests).repartition(parts, "block").groupBy("block").applyInArrow(apply, schema)

    # a round reads the files of the one before, which its shuffle waits for; a task that runs again makes the same rows and files
    requests = of_blocks(source.mapInArrow(first, REQUEST), second, REQUEST)
    requests = of_blocks(requests, third, REQUEST)
    kept = of_blocks(requests, last, "doc_id long, n_words long, n_removed long, kept binary")
    return kept.select("doc_id", "n_words", "n_removed", F.expr("cast(kept AS string)").alias("kept_text"))


def removal_digest(docs: DataFrame, window: int = 35) -> DataFrame:
    """``repeated_passages`` with the kept text as its SHA-256."""
    return repeated_passages(docs, window).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def oracle_sql(window: int = 35) -> str:
    """``removal_digest`` of the table ``documents`` by its definition."""
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    starts AS (SELECT r, unnest(range(1, len(w) - {window} + 2)) AS i, w FROM docs),
    repeated AS (SELECT r, i FROM starts QUALIFY count(*) OVER (PARTITION BY sha256(array_to_string(w[i:i + {window} - 1], ' '))) > 1),
    removed AS (SELECT DISTINCT r, unnest(range(i, i + {window})) AS i FROM repeated),
    words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs),
    kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN removed USING (r, i) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM docs LEFT JOIN kept USING (r)"""


def _places(offsets: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of the given texts are, and the offsets of these texts in a row."""
    n = (offsets[1:] - offsets[:-1])[texts]
    parts = _offsets(n)
    return np.arange(parts[-1]) + np.repeat(offsets[texts] - parts[:-1], n), parts
