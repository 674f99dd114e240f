"""Blocks: a distributed join of the documents' tokens with what is known of each distinct token.

Joining every (document, token) pair with a corpus-wide table would shuffle the corpus.  Here a
block of documents (about 16 MB of text) numbers its distinct tokens, keeps each document's
numbers and frequencies in a file of the shared folder, and asks for each distinct token once.
Requests are dealt out by token; a token asks at most once per block, so even the most common
one is a small key, and no side is broadcast.  Answers return to the block as packed arrays.

Blocks are numbered by partition and place within it.  A scan of files deals the same rows in the
same order to a task that runs again, so its block files and requests come out the same; any
other input is written to the shared folder first.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lodeframe.llm.texts import as_bytes, sliced
from lodeframe.storage import publish, shared_path, stored

REQUESTS = "ref long, token binary, weight long"
#: Bits of a request's number that hold the token's number within its block.
LOCAL_BITS = 28
LANES = 100_000
#: Bytes of text in a block, unless a single text is longer.
BLOCK_BYTES = 16 << 20
#: Answers that a task packs at once.
PACKED = 500_000


def scanned(df: DataFrame) -> DataFrame:
    """``df`` if it only scans, filters and projects files, else a stored copy of it."""
    plan = df._jdf.queryExecution().optimizedPlan()
    nodes = [line.strip(" +-:").split(" ")[0] for line in plan.toString().splitlines()]
    return df if all(n in ("Project", "Filter", "Relation") or n.startswith("Relation[") for n in nodes if n) else stored(df, "rows")


def write_blocks(docs: DataFrame, split: Callable[[bytes], list[bytes]], weight: str | None = None, measure: Callable[[list[list[bytes]]], dict[str, np.ndarray]] | None = None) -> tuple[DataFrame, str]:
    """Cut ``docs`` (doc_id, text, and longs that are carried along) into blocks.

    Returns the requests, each token weighted by its occurrences in documents where the column
    ``weight`` is 1 (all documents if None), and the folder that holds the blocks once the
    requests were computed.  Every block also asks for the empty token, as its number 0.
    ``measure`` makes further columns of the block from its documents' tokens.
    """
    folder = shared_path(docs.sparkSession, "blocks")
    carried = [c for c in docs.columns if c != "text"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        made, own = context.partitionId() << 12, f".attempt-{context.taskAttemptId()}"
        block = _Block(carried, weight)
        for part in sliced(batches, limit=2 << 20):
            block.add(part, split, measure)
            if block.n_bytes >= BLOCK_BYTES:
                yield from block.closed(folder, made, own)
                made, block = made + 1, _Block(carried, weight)
        if block.parts:
            yield from block.closed(folder, made, own)

    return scanned(docs).mapInArrow(build, REQUESTS), folder


class _Block:
    def __init__(self, carried: list[str], weight: str | None):
        self.carried, self.weight = carried, weight
        self.numbers: dict[bytes, int] = defaultdict(count().__next__)
        self.numbers[b""]
        self.parts: list[pa.RecordBatch] = []
        self.ids: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.n_bytes = 0

    def add(self, batch: pa.RecordBatch, split: Callable, measure: Callable | None) -> None:
        texts = as_bytes(batch.column("text"))
        number = self.numbers.__getitem__
        cut = [split(text) for text in texts]
        self.ids.extend(np.fromiter(map(number, tokens), np.int32, len(tokens)) for tokens in cut)
        self.sizes.extend(map(len, texts))
        own = {c: pa.array(x) for c, x in measure(cut).items()} if measure else {}
        self.parts.append(pa.RecordBatch.from_pydict({c: pa.concat_arrays([batch.column(c)]) for c in self.carried} | own))
        self.n_bytes += sum(map(len, texts))

    def closed(self, folder: str, block: int, own: str) -> Iterator[pa.RecordBatch]:
        """Write the block's file, give out its requests."""
        n_all = np.fromiter(map(len, self.ids), np.int64, len(self.ids))
        v = len(self.numbers)
        keys = np.repeat(np.arange(len(n_all), dtype=np.int64) * v, n_all)
        keys += np.concatenate(self.ids)
        self.ids.clear()
        keys.sort()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        freqs = np.diff(np.append(first, len(keys)))
        doc, local = np.divmod(keys[first], v)
        offsets = pa.array(np.searchsorted(doc, np.arange(len(n_all) + 1)).astype(np.int32))
        table = pa.Table.from_batches(self.parts)
        held = {c: table.column(c).combine_chunks() for c in table.column_names}
        held |= {"n_bytes": pa.array(self.sizes, pa.int64()), "n_all": pa.array(n_all)}
        held |= {"ids": pa.ListArray.from_arrays(offsets, pa.array(local.astype(np.int32))), "freqs": pa.ListArray.from_arrays(offsets, pa.array(freqs.astype(np.int32)))}
        whole = pa.RecordBatch.from_pydict(held)
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{block}{own}") as sink, pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(whole)
        publish(fs, f"{root}/{block}{own}", f"{root}/{block}.arrow")
        counted = freqs if self.weight is None else freqs * np.asarray(table.column(self.weight).fill_null(0), dtype=np.int64)[doc]
        weights = np.bincount(local, counted, minlength=v).astype(np.int64)
        tokens = list(self.numbers)
        refs = (block << LOCAL_BITS) + np.arange(v)
        for k in range(0, v, LANES):
            yield pa.RecordBatch.from_arrays([pa.array(refs[k : k + LANES]), pa.array(tokens[k : k + LANES], pa.binary()), pa.array(weights[k : k + LANES])], ["ref", "token", "weight"])


def answer(requests: DataFrame, folder: str, known: Callable[[list[bytes], dict[str, np.ndarray]], dict[str, np.ndarray]], finish: Callable[[pa.RecordBatch, dict[str, np.ndarray]], pa.Table], schema: str) -> DataFrame:
    """Answer all requests and let each block make its rows.

    ``requests`` (ref, token, further columns that depend on the token only) must come with equal
    tokens next to each other.  ``known`` gets distinct tokens, with their further columns, and
    gives arrays of values.  ``finish`` gets a block's documents and, for each value, an array
    that is indexed by the numbers in ``ids``.
    """
    further = [c for c in requests.columns if c not in ("ref", "token", "weight")]

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs, values, n = [], [], 0
        last: tuple[bytes | None, dict] = None, {}
        for batch in batches:
            codes = batch.column("token").dictionary_encode()
            tokens = codes.dictionary.to_pylist()
            index = np.asarray(codes.indices)
            if not len(tokens):
                continue
            starts = np.zeros(len(tokens), np.int64)
            starts[index[::-1]] = np.arange(len(index))[::-1]
            skip = int(tokens[0] == last[0])  # answered at the end of the batch before
            got = known(tokens[skip:], {c: np.asarray(batch.column(c))[starts[skip:]] for c in further}) if len(tokens) > skip else {}
            if skip:
                got = {c: np.concatenate([[x], got[c]]) if got else np.array([x]) for c, x in last[1].items()}
            last = tokens[-1], {c: x[-1] for c, x in got.items()}
            refs.append(np.asarray(batch.column("ref")))
            values.append({c: x[index] for c, x in got.items()})
            n += len(index)
            if n >= PACKED:
                yield packed(refs, values)
                refs, values, n = [], [], 0
        if n:
            yield packed(refs, values)

    def packed(refs: list[np.ndarray], values: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        ref = np.concatenate(refs)
        order = np.argsort(ref)
        ref = ref[order]
        block = ref >> LOCAL_BITS
        starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        ends = np.append(starts[1:], len(ref))
        columns = {"local": (ref & ((1 << LOCAL_BITS) - 1)).astype(np.int32)} | {c: np.concatenate([v[c] for v in values])[order] for c in values[0]}
        sent = []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            part = pa.RecordBatch.from_pydict({c: pa.array(x[a:b]) for c, x in columns.items()} | {"local": pa.array(np.diff(columns["local"][a:b], prepend=0).astype(np.int32))})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(part)
            sent.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(block[starts]), pa.array(sent, pa.binary())], ["block", "answers"])

    def close(table: pa.Table) -> pa.Table:
        got = [batch for x in table.column("answers") for batch in pa.ipc.open_stream(x.as_buffer())]
        local = np.concatenate([np.cumsum(np.asarray(batch.column("local"))) for batch in got])
        arrays = {}
        for c in got[0].schema.names[1:]:
            part = np.concatenate([np.asarray(batch.column(c)) for batch in got])
            arrays[c] = np.zeros(len(local), part.dtype)
            arrays[c][local] = part
        fs, root = pafs.FileSystem.from_uri(folder)
        with fs.open_input_file(f"{root}/{table.column('block')[0].as_py()}.arrow") as f:
            return pa.concat_tables([finish(batch, arrays) for batch in pa.ipc.open_stream(f)])

    return requests.mapInArrow(answers, "block long, answers binary").groupBy("block").applyInArrow(close, schema)


def by_token(requests: DataFrame) -> DataFrame:
    """The requests with equal tokens next to each other."""
    return requests.repartition("token").sortWithinPartitions("token")


def lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, frequencies and offsets of a block's documents."""
    ids = batch.column("ids")
    return np.asarray(ids.values), np.asarray(batch.column("freqs").values), np.asarray(ids.offsets)
