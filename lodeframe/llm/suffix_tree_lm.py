"""Language-model scores by a probabilistic suffix tree.

A text is its words, A-Z lower-cased, a space between them, and an end; the model's symbols are
the bytes of that, all 256 of them.  The contexts of a symbol are the symbols before it, across
words, back to the text's start, ``depth`` at most.  (Tree: Ron, Singer and Tishby, "The Power of
Amnesia", 1996.)

* Candidates are the contexts that precede at least ``least_count`` symbols, and at least the share
  ``least_share`` of all if one is given.  The count is absolute, so the tree grows with the corpus.
* A candidate is retained, with its suffixes, if its next symbols diverge from its longest
  suffix's: its count times the Kullback-Leibler divergence is above ``divergence`` nats.  In
  ``suffix_tree_scores`` candidates of up to ``SHORT`` symbols are retained without that test.
* Next-symbol distributions are smoothed towards the suffix's (Witten-Bell), the root's towards
  the uniform one over bytes; a state's probabilities over the 256 bytes add up to 1.
* A symbol is scored in the state of the longest retained suffix of what comes before it.

A gram is a symbol with its ``depth`` contexts' symbols.  One pass over the documents cuts them
into blocks; a block asks for each of its distinct grams and tokens once and says how often they
are in training texts.  Grams are dealt out in buckets by the nearest ``SHORT + 1`` context symbols:
all longer contexts of a gram are where it is, and what the shorter ones need is complete in a
table of ``SHORT + 1`` bytes, which the size of the alphabet bounds.  A bucket's part of the tree is
made where its requests meet, and answers them; nothing that grows with the corpus is broadcast
or held by the driver.  Requests go to their bucket twice, to be counted and to be answered, so a
task holds a bucket's distinct grams but never its requests.

All counts cover all training documents, for the tree and for the base score.

Cases: null text counts as empty (one token, the end); a row without an id is a training row;
repeated rows count as often as they stand; an empty table gives no rows; without training
texts the tree is the uniform one; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain, count, islice
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.blocks import scanned
from lodeframe.llm.texts import as_bytes, id_and_text, sliced, sums_by
from lodeframe.storage import publish, shared_path, stored

SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: The symbol of a text's end, and of its start as a context.  White space is never in a word.
END = 10
#: A word may hold a zero byte, which marks "no symbol" in packed contexts; it is spelled as a tab.
TABS = bytes.maketrans(b"\0", b"\t")
#: Contexts of up to 7 symbols and the next one fit a number of 64 bits.
MAX_DEPTH = 7
BYTES = 256
#: Contexts of up to so many symbols are worked out for all grams at once.
SHORT = 2
#: Bytes of text in a block of grams, unless a single text is longer.
GRAM_BLOCK = 16 << 20
#: Distinct grams beyond those known that are held before they are merged.
HELD = 1_500_000
#: Grams are dealt out in so many buckets (as a power of two).
BUCKET_BITS = 10
#: Packed requests in a batch.
PACKS = 256
#: Kinds of requests.
GRAMS, TOKENS, LOWS = range(3)
ANSWERS = "block long, bucket long, pack binary"
#: The block to which a bucket of tokens tells its sums.
ALL = -1
#: Odd numbers that spread keys over 64 bits.
MULTIPLIERS = [np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64) | 1) for k in range(8)]


def spelled(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of the texts (lists of words) in a row, and where each text begins."""
    parts = [b" ".join(words) for words in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    return np.frombuffer((b"\n".join(parts) + b"\n" if parts else b"").translate(TABS), np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def suffix_mask(depth: int) -> np.uint64:
    return np.uint64((1 << (8 * depth)) - 1)


def grams_of(symbols: np.ndarray, offsets: np.ndarray, depth: int) -> np.ndarray:
    """The gram of each symbol, the symbol lowest, above it its ``depth`` contexts' symbols, the
    nearest lowest; nothing before a text's start."""
    n = len(symbols)
    wide = np.concatenate([np.full(8, END, np.uint8), symbols])
    # the eight bytes that end with each symbol, read as one number
    grams = np.ndarray((n,), ">u8", wide, offset=1, strides=(1,)).astype(np.uint64) & suffix_mask(depth + 1)
    for place in range(depth - 1):
        at = offsets[:-1] + place
        grams[at[at < offsets[1:]]] &= suffix_mask(place + 2)
    return grams


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts (1 each if None)."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sums = np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts, first) if len(first) else counts
    return keys[first], sums


def smoothed(grams: np.ndarray, counts: np.ndarray, depths: range, below: np.ndarray, best: np.ndarray, least: float, divergence: float) -> tuple[np.ndarray, np.ndarray, int]:
    """For each gram its symbol's smoothed probability in its longest candidate context and in its
    longest retained one, of the given depths, and how many contexts are retained.

    ``grams`` are distinct and have all grams of their contexts; ``counts`` may be zero.  ``below``
    and ``best`` are the same two for the depths before the first.
    """
    levels, n_retained = [], 0
    for d in depths:
        own, row = np.unique(grams & suffix_mask(d + 1), return_inverse=True)
        n = np.bincount(row, counts, len(own))
        context, at = np.unique(own >> np.uint64(8), return_inverse=True)
        total, kinds = np.bincount(at, n, len(context)), np.bincount(at, n > 0, len(context))
        # a suffix that reaches beyond the text's start is none
        candidate = (context >> np.uint64(8 * (d - 1)) != 0) & (total >= max(least, 1)) if d else total > 0
        before = np.empty(len(own))
        before[row] = below
        p = np.where(candidate[at], (n + kinds[at] * before) / np.maximum(total + kinds, 1)[at], before)
        gain = np.bincount(at, n * np.log(p / before), len(context))
        below = p[row]
        levels.append((below, at[row], candidate & (gain > divergence) if d else np.ones(len(context), bool)))
    longer = np.zeros(len(grams), bool)
    chosen = best.copy()
    for p, context, keep in reversed(levels):
        keep = keep | (np.bincount(context, longer, len(keep)) > 0)
        n_retained += int(keep.sum())
        now = keep[context]
        chosen = np.where(now & ~longer, p, chosen)
        longer |= now
    return below, chosen, n_retained


class SuffixTree:
    """The model in memory, for small training texts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, depth: int, least: float, divergence: float):
        self.grams, self.counts = counted(grams, counts)
        self.depth, self.least, self.divergence = depth, least, divergence
        self.n_retained = self._smoothed(self.grams, self.counts)[2]

    def _smoothed(self, grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        start = np.full(len(grams), 1 / BYTES)
        return smoothed(grams, counts, range(self.depth + 1), start, start, self.least, self.divergence)

    def probabilities(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of the symbol of each of ``grams``, which are sorted and hold all of the tree's."""
        return self._smoothed(grams, counts)[1]

    def scores(self, texts: list[list[bytes]]) -> np.ndarray:
        """The log10 probability of each text."""
        symbols, offsets = spelled(texts)
        asked = grams_of(symbols, offsets, self.depth)
        grams, counts = counted(np.concatenate([self.grams, asked]), np.concatenate([self.counts, np.zeros(len(asked), np.int64)]))
        return sums_by(np.log10(self.probabilities(grams, counts))[np.searchsorted(grams, asked)], offsets)


class Places:
    """Finds the places of keys in a sorted array, by tables of hashes; a key that loses its slot
    to another goes to the next table."""

    def __init__(self, keys: np.ndarray, tables: int = 5):
        self.keys, self.tables = keys, []
        left = np.arange(len(keys), dtype=np.int32)
        for k in range(tables):
            if not len(left):
                break
            bits = max(4, (2 * len(left)).bit_length())
            table = np.zeros(1 << bits, np.int32)
            slots = self._slots(keys[left], k, bits)
            table[slots] = left
            self.tables.append((bits, table))
            left = left[table[slots] != left]

    @staticmethod
    def _slots(keys: np.ndarray, table: int, bits: int) -> np.ndarray:
        return ((keys ^ keys >> np.uint64(29)) * MULTIPLIERS[table] >> np.uint64(64 - bits)).view(np.int64)

    def find(self, asked: np.ndarray) -> np.ndarray:
        """The place of each of ``asked``, all of which are among the keys."""
        out = np.zeros(len(asked), np.int32)
        left = np.arange(len(asked))
        for k, (bits, table) in enumerate(self.tables):
            own = asked if k == 0 else asked[left]
            place = table[self._slots(own, k, bits)]
            if k == 0:
                out = place
            else:
                out[left] = place
            missed = np.flatnonzero(self.keys[place] != own)
            left = left[missed]
            if not len(left):
                return out
        out[left] = np.searchsorted(self.keys, asked[left])
        return out


def _packed(**columns: np.ndarray | pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_pydict({c: pa.array(x) for c, x in columns.items()})
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    batch = pa.ipc.open_stream(data).read_next_batch()
    return {c: batch.column(c) if pa.types.is_binary(batch.column(c).type) else np.asarray(batch.column(c)) for c in batch.schema.names}


def bucket_of(grams: np.ndarray) -> np.ndarray:
    """A number that depends on the nearest ``SHORT + 1`` symbols of the context only."""
    near = grams >> np.uint64(8) & suffix_mask(SHORT + 1)
    return (near * MULTIPLIERS[0] >> np.uint64(64 - BUCKET_BITS)).astype(np.uint16)


def in_buckets(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by bucket, and where in that order each bucket that occurs begins and ends."""
    order = np.argsort(buckets, kind="stable")
    own = buckets[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    return order, first, np.append(first[1:], len(own))


class Counts:
    """Distinct grams and how often each is in training texts."""

    def __init__(self) -> None:
        self.held, self.n = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0

    def add(self, grams: np.ndarray, counts: np.ndarray) -> None:
        self.held.append((grams, counts))
        self.n += len(grams)
        if self.n > HELD + len(self.held[0][0]):
            self.merged()

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if self.n:
            self.held, self.n = [counted(*map(np.concatenate, zip(*self.held, strict=True)))], 0
        return self.held[0]


class _Block:
    """Documents that ask for their distinct grams and tokens together."""

    def __init__(self, depth: int):
        self.depth, self.n_bytes = depth, 0
        self.grams = Counts()
        self.numbers: dict[bytes, int] = defaultdict(count().__next__)
        self.weights = np.zeros(0, np.int64)
        self.parts: list[pa.RecordBatch] = []

    def add(self, batch: pa.RecordBatch) -> None:
        words = [text.lower().split() for text in as_bytes(batch.column("text"))]
        train = np.asarray(batch.column("train")) == 1
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(words)), np.int32, int(sizes.sum()))
        weights = np.bincount(ids[np.repeat(train, sizes)], minlength=len(self.numbers))
        weights[: len(self.weights)] += self.weights
        self.weights = weights
        symbols, offsets = spelled(words)
        grams, learned = grams_of(symbols, offsets, self.depth), np.repeat(train, np.diff(offsets))
        self.grams.add(*counted(grams[learned]))
        asked = counted(grams[~learned])[0]
        self.grams.add(asked, np.zeros(len(asked), np.int64))
        own = pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(symbols)])
        held = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)])), pa.array(ids))
        self.parts.append(pa.RecordBatch.from_pydict({"doc_id": pa.concat_arrays([batch.column("doc_id")]), "train": pa.array(train), "symbols": own, "ids": held}))
        self.n_bytes += len(symbols)

    def write(self, folder: str, block: int, own: str, token_bits: int) -> None:
        """Write the documents, and the block's grams and tokens in the order in which it asks."""
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        asked = {"grams": np.diff(self.grams.merged()[0], prepend=np.uint64(0)), "tokens": _token_buckets(self.numbers, token_bits)[0].astype(np.int32)}
        for name, values in asked.items():
            with fs.open_output_stream(f"{root}/{block}.{name}{own}") as sink:
                sink.write(_packed(own=values))
            publish(fs, f"{root}/{block}.{name}{own}", f"{root}/{block}.{name}")
        with fs.open_output_stream(f"{root}/{block}{own}") as sink, pa.ipc.new_stream(sink, self.parts[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for part in self.parts:
                out.write_batch(part)
        publish(fs, f"{root}/{block}{own}", f"{root}/{block}.arrow")

    def requests(self, token_bits: int) -> Iterator[tuple[int, int, bytes]]:
        """(kind, bucket, packed request)"""
        grams, counts = self.grams.merged()
        buckets = bucket_of(grams)
        order, first, last = in_buckets(buckets)
        for a, b in zip(first, last, strict=True):
            own = order[a:b]
            yield GRAMS, int(buckets[own[0]]), _packed(grams=np.diff(grams[own], prepend=np.uint64(0)), counts=counts[own].astype(np.int32))
        order, first, last, tokens = *_token_buckets(self.numbers, token_bits), list(self.numbers)
        for a, b in zip(first, last, strict=True):
            own = [tokens[k] for k in order[a:b]]
            yield TOKENS, crc32(own[0]) & (1 << token_bits) - 1, _packed(tokens=pa.array(own, pa.binary()), weights=self.weights[order[a:b]])


def _token_buckets(tokens: Iterable[bytes], token_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes = np.fromiter(map(crc32, tokens), np.uint32)
    return in_buckets((hashes & np.uint32((1 << token_bits) - 1)).astype(np.uint16))


def ask(rows: DataFrame, depth: int, block_bytes: int) -> tuple[DataFrame, str]:
    """Cut ``rows`` (doc_id, text, train) into blocks, each written to the folder that is returned.
    Requests (kind, bucket, block, pack) hold all of a block's grams or tokens of one bucket with
    their counts; of kind ``LOWS`` are a task's grams of ``SHORT`` context symbols."""
    folder = shared_path(rows.sparkSession, "grams")
    # a token bucket is for about 32 MB of the scanned files
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    token_bits = min(16, max(8, (size >> 25).bit_length()))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        made, own, lows = context.partitionId() << 12, f".attempt-{context.taskAttemptId()}", Counts()

        def closed(block: _Block) -> Iterator[pa.RecordBatch]:
            block.write(folder, made, own, token_bits)
            grams, counts = block.grams.merged()
            lows.add(*counted(grams & suffix_mask(SHORT + 1), counts))
            requests = block.requests(token_bits)
            while some := list(islice(requests, PACKS)):
                kinds, buckets, packs = zip(*some, strict=True)
                yield to_batch(kinds, buckets, made, packs)

        def to_batch(kinds: Sequence[int], buckets: Sequence[int], block: int, packs: Sequence[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int64()), pa.array(buckets, pa.int64()), pa.array([block] * len(packs), pa.int64()), pa.array(packs, pa.binary())], ["kind", "bucket", "block", "pack"])

        block = _Block(depth)
        for part in sliced(batches, limit=2 << 20):
            block.add(part)
            if block.n_bytes >= block_bytes:
                yield from closed(block)
                made, block = made + 1, _Block(depth)
        if block.parts:
            yield from closed(block)
        grams, counts = lows.merged()
        if len(grams):
            yield to_batch([LOWS], [0], made, [_packed(grams=grams, counts=counts)])

    asked = scanned(rows).mapInArrow(build, "kind long, bucket long, block long, pack binary")
    return stored(asked, "requests"), folder


def short_grams(requests: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All grams of ``SHORT`` context symbols and how often each is in training texts."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack in batch.column("pack").to_pylist():
                own = _unpacked(pack)
                yield pa.RecordBatch.from_arrays([pa.array(own["grams"].astype(np.int64)), pa.array(own["counts"])], ["gram", "n"])

    got = requests.where(F.col("kind") == LOWS).select("pack").mapInArrow(opened, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    return counted(np.asarray(got.column("gram")).astype(np.int64).view(np.uint64), np.asarray(got.column("n")).astype(np.int64))


def _by_bucket(requests: DataFrame, make: Callable[[], GramBucket | TokenBucket]) -> DataFrame:
    """What a bucket that ``make`` makes answers to its requests, once it has counted them all."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            blocks, sent = [], []
            for bucket, phase, block, pack in zip(*(batch.column(c).to_pylist() for c in ("bucket", "phase", "block", "pack")), strict=True):
                if bucket != last:
                    last, held = bucket, make()
                own = _unpacked(pack)
                if phase == 0:
                    held.count(own)
                    continue
                for to, answer in held.answers(own):
                    blocks.append((block if to is None else to, bucket))
                    sent.append(answer)
            if sent:
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in zip(*blocks, strict=True)), pa.array(sent, pa.binary())], ["block", "bucket", "pack"])

    twice = requests.select("bucket", F.explode(F.array(F.lit(0), F.lit(1))).alias("phase"), "block", "pack")
    return twice.repartition("bucket").sortWithinPartitions("bucket", "phase").mapInArrow(solve, ANSWERS)


class GramBucket:
    """A bucket that answers with the log10 probabilities of the grams, in their order."""

    def __init__(self, lows: tuple[np.ndarray, np.ndarray, np.ndarray], depth: int, least: float, divergence: float):
        self.lows, self.depth, self.least, self.divergence = lows, depth, least, divergence
        self.counts, self.p = Counts(), None

    def count(self, own: dict) -> None:
        self.counts.add(np.cumsum(own["grams"]), own["counts"].astype(np.int64))

    def answers(self, own: dict) -> Iterator[tuple[int | None, bytes]]:
        if self.p is None:
            grams, counts = self.counts.merged()
            lows, below, best = self.lows
            short = min(SHORT, self.depth)
            at = np.searchsorted(lows, grams & suffix_mask(short + 1))
            p = smoothed(grams, counts, range(short + 1, self.depth + 1), below[at], best[at], self.least, self.divergence)[1]
            self.grams, self.p = grams, np.log10(p).astype(np.float32)
        yield None, _packed(p=self.p[np.searchsorted(self.grams, np.cumsum(own["grams"]))])


class TokenBucket:
    """A bucket that answers with the tokens' training counts, and once with their number and sum."""

    def __init__(self) -> None:
        self.c: dict[bytes, int] = {}
        self.told = False

    def count(self, own: dict) -> None:
        c = self.c
        for token, n in zip(own["tokens"].to_pylist(), own["weights"].tolist(), strict=True):
            c[token] = c.get(token, 0) + n

    def answers(self, own: dict) -> Iterator[tuple[int | None, bytes]]:
        if not self.told:
            self.told = True
            yield ALL, np.array([sum(self.c.values()), sum(map(bool, self.c.values()))], "<i8").tobytes()
        yield None, _packed(c=np.array([self.c[t] for t in own["tokens"].to_pylist()], np.int64))


def answer_grams(requests: DataFrame, lows: tuple[np.ndarray, np.ndarray], depth: int, least_count: int, least_share: float, divergence: float) -> DataFrame:
    grams, counts = lows
    short = min(SHORT, depth)
    if short < SHORT:
        grams, counts = counted(grams & suffix_mask(short + 1), counts)
    least = max(least_count, least_share * counts.sum())
    start = np.full(len(grams), 1 / BYTES)
    sent = requests.sparkSession.sparkContext.broadcast((grams, *smoothed(grams, counts, range(short + 1), start, start, least, -np.inf)[:2]))
    return _by_bucket(requests.where(F.col("kind") == GRAMS), lambda: GramBucket(sent.value, depth, least, divergence))


def train_suffix_tree(docs: DataFrame, depth: int = 6, least_share: float = 0.0, divergence: float = 4.0, least_count: int = 2) -> SuffixTree:
    """The tree of all texts of ``docs`` (a column ``text`` without nulls), in the driver's memory."""
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth is from 1 to {MAX_DEPTH}")
    texts = [r["text"].encode().lower().split() for r in docs.select("text").collect()]
    grams = grams_of(*spelled(texts), depth)
    return SuffixTree(grams, np.ones(len(grams), np.int64), depth, max(least_count, least_share * len(grams)), divergence)


def suffix_tree_scores(docs: DataFrame, depth: int = 6, least_share: float = 0.0, divergence: float = 4.0, folds: int = 7, held_fold: int = 2, id_col: str = "doc_id", text_col: str = "text", least_count: int = 2, block_bytes: int = GRAM_BLOCK) -> DataFrame:
    """One row per document; learns from those whose crc32(id as text) mod ``folds`` isn't
    ``held_fold``."""
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth is from 1 to {MAX_DEPTH}")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held_fold, F.lit(False))
    rows = scanned(id_and_text(docs, id_col, text_col)).withColumn("train", (~held).cast("long"))
    requests, folder = ask(rows, depth, block_bytes)
    counts = stored(_by_bucket(requests.where(F.col("kind") == TOKENS), TokenBucket), "counts")
    grams = answer_grams(requests, short_grams(requests), depth, least_count, least_share, divergence)
    ends = rows.where("train = 1").count()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = np.array([np.frombuffer(x, "<i8") for x in batch.column("pack").to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(told[:, 0]), pa.array(told[:, 1])], ["words", "kinds"])

    totals = counts.where(F.col("block") == ALL).select("pack").mapInArrow(summed, "words long, kinds long").agg(F.sum("words").alias("words"), F.sum("kinds").alias("kinds")).first()
    n, v = (totals["words"] or 0) + ends, (totals["kinds"] or 0) + (ends > 0)

    def close(table: pa.Table) -> pa.Table:
        """A block's rows from the answers to its requests."""
        fs, root = pafs.FileSystem.from_uri(folder)
        name = f"{root}/{table.column('block')[0].as_py()}"
        answers: dict[int, list[tuple[int, bytes]]] = {GRAMS: [], TOKENS: []}
        for kind, bucket, pack in zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "pack")), strict=True):
            answers[kind].append((bucket, pack))

        def asked(what: str) -> np.ndarray:
            with fs.open_input_file(f"{name}.{what}") as f:
                return _unpacked(f.read())["own"]

        def in_place(kind: int, column: str, order: np.ndarray) -> np.ndarray:
            out = np.zeros(len(order), np.float64 if kind == GRAMS else np.int64)
            if len(order):
                out[order] = np.concatenate([_unpacked(pack)[column] for _, pack in sorted(answers[kind])])
            return out

        grams = np.cumsum(asked("grams"))
        places, p = Places(grams), in_place(GRAMS, "p", in_buckets(bucket_of(grams))[0])
        c = in_place(TOKENS, "c", asked("tokens"))
        each, known = np.log10((c + 1) / (n + v + 1)), (c > 0).astype(np.int64)
        end, out = np.log10((ends + 1) / (n + v + 1)), []
        with fs.open_input_file(f"{name}.arrow") as f:
            for part in pa.ipc.open_stream(f):
                symbols, ids = part.column("symbols"), part.column("ids")
                offsets = np.frombuffer(symbols.buffers()[1], np.int64)[: len(symbols) + 1]
                text = np.frombuffer(symbols.buffers()[2], np.uint8)[: offsets[-1]]
                words, own = np.asarray(ids.offsets), np.asarray(ids.values)
                out.append(pa.table({
                    "doc_id": part.column("doc_id"), "held_out": pc.invert(part.column("train")), "n_tokens": pa.array(np.diff(words) + 1), "n_known": pa.array(sums_by(known[own], words) + (ends > 0)),
                    "train_tokens": pa.array(np.full(part.num_rows, n, np.int64)), "base_score": pa.array(sums_by(each[own], words) + end), "score": pa.array(sums_by(p[places.find(grams_of(text, offsets, depth))], offsets)),
                }))
        return pa.concat_tables(out)

    answered = [a.select(F.lit(kind).alias("kind"), "block", "bucket", "pack") for kind, a in ((GRAMS, grams), (TOKENS, counts.where(F.col("block") != ALL)))]
    return answered[0].unionByName(answered[1]).groupBy("block").applyInArrow(close, SCHEMA)
