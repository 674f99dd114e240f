"""Token ids as Arrow files of equal-length sequences and masks.

The documents' ids, each document closed by an end id, form one long row in ascending doc_id
order.  It is dealt out as shards, one Arrow IPC file each: record batches of ``rows`` sequences,
a column ``ids`` of fixed-size lists of ``length`` unsigned integers (16 bits if the vocabulary
allows, else 32) and a column ``mask`` of fixed-size lists of booleans (false: padding, at the
end of a shard's last sequence only).  Buffers are not compressed, so a memory-mapped file gives
any sequence as a view, at an offset that follows from its number; so is a mask's packed bits.  A task goes on in a further shard once one holds ``shard_ids`` ids.  Beside each shard lies
``*.docs.arrow`` with its documents' ids, starts within the shard and lengths, written and read
in batches; a document is in one shard.

A task writes to a name of its own and then renames, so a task that runs twice, or is lost half
way, leaves no partial shard.  Shards go to a folder that the driver and all executors share.

Cases: null text counts as empty and still gets its end id; rows without an id come first;
repeated rows (and ties on doc_id) each have their own ids, ordered by a hash of the text, then
text; bytes that aren't UTF-8 count as the replacement character; an empty table
gives no shard and no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm import vocab
from lodeframe.llm.texts import id_and_text, sliced, sums_by
from lodeframe.storage import publish, shared_path

DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
#: Sequences in a record batch.
ROWS = 256
#: Ids after which a task begins a further shard.
SHARD_IDS = 1 << 27


def encoded(texts: pa.Array, tokenizer: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the texts in a row, an end id after each, and each text's number of ids.

    Arrow finds the distinct parts, so that only these are looked up one by one.
    """
    parts, first = vocab.parts(tokenizer, texts)
    distinct = parts.dictionary_encode()
    known = vocab.remembered(tokenizer)
    which = known.learn(distinct.dictionary.to_pylist())[np.asarray(distinct.indices)]
    took = known.counts[which]
    begins = np.cumsum(took) - took
    ids = known.flat[np.repeat(known.starts[which] - begins, took) + np.arange(int(took.sum()))]
    lengths = sums_by(took, first)
    return np.insert(ids, np.cumsum(lengths), end_id), lengths + 1


class _Shard:
    """A shard that is being written, with its index beside it."""

    def __init__(self, folder: str, number: int, own: str, length: int, schema: pa.Schema, end_id: int):
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.number, self.own, self.name = number, own, f"{root}/shard-{number:012d}"
        self.length, self.schema, self.end_id = length, schema, end_id
        self.sinks = [self.fs.open_output_stream(f"{self.name}{x}{own}") for x in ("", ".docs")]
        self.out, self.docs = pa.ipc.new_file(self.sinks[0], schema), pa.ipc.new_file(self.sinks[1], DOCS)
        self.n_ids, self.rest = 0, np.zeros(0, np.uint32)

    def add(self, doc_ids: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.docs.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(self.n_ids + np.cumsum(lengths) - lengths), pa.array(lengths)], schema=DOCS))
        self.n_ids += len(ids)
        self.rest = np.concatenate([self.rest, ids])
        size = ROWS * self.length
        whole = len(self.rest) // size * size
        for k in range(0, whole, size):
            self._write(self.rest[k : k + size], size)
        self.rest = self.rest[whole:]

    def _write(self, flat: np.ndarray, valid: int) -> None:
        ids = pa.FixedSizeListArray.from_arrays(pa.array(flat.astype(self.schema.field("ids").type.value_type.to_pandas_dtype())), self.length)
        mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(flat)) < valid), self.length)
        self.out.write_batch(pa.RecordBatch.from_arrays([ids, mask], schema=self.schema))

    def closed(self) -> pa.RecordBatch:
        if len(self.rest):
            self._write(np.pad(self.rest, (0, -len(self.rest) % self.length), constant_values=self.end_id), len(self.rest))
        for x in (self.out, self.docs, *self.sinks):
            x.close()
        for x in (".docs", ""):
            publish(self.fs, f"{self.name}{x}{self.own}", f"{self.name}{x}.arrow")
        return pa.RecordBatch.from_pydict({"shard": [self.number], "n_ids": [self.n_ids]})


def write_sequences(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> list[tuple[int, int]]:
    """Write all documents' ids below ``folder``; returns (shard, number of ids) in order.

    What reaches the driver is one number per shard.
    """
    small = vocab.vocabulary_size(tokenizer) <= 1 << 16
    value = pa.uint16() if small else pa.uint32()
    schema = pa.schema([("ids", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number, own = context.partitionId() << 20, f".attempt-{context.taskAttemptId()}"
        shard = None
        for batch in sliced(batches, limit=4 << 20):
            ids, lengths = encoded(batch.column("text"), tokenizer, end_id)
            ends, first = np.cumsum(lengths), 0
            while first < len(lengths):
                shard = shard or _Shard(folder, number, own, length, schema, end_id)
                start = ends[first] - lengths[first]
                last = min(len(lengths), first + 1 + int(np.searchsorted(ends[first:], start + shard_ids - shard.n_ids)))
                shard.add(batch.column("doc_id").slice(first, last - first), ids[start : ends[last - 1]], lengths[first:last])
                first = last
                if shard.n_ids >= shard_ids:
                    yield shard.closed()
                    shard, number = None, number + 1
        if shard:
            yield shard.closed()

    rows = id_and_text(docs, id_col, text_col)
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    # the shuffle is the only one; no count is given, so that small shards may be merged
    written = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "text").mapInArrow(write, "shard long, n_ids long").collect()
    return sorted((r["shard"], r["n_ids"]) for r in written)


class Sequences:
    """A shard, opened for reading.  On a local or mounted path its buffers are mapped, not read."""

    def __init__(self, folder: str, shard: int, length: int):
        fs, root = pafs.FileSystem.from_uri(folder)
        name = f"{root}/shard-{shard:012d}"
        local = isinstance(fs, pafs.LocalFileSystem)
        self.source = pa.memory_map(f"{name}.arrow") if local else fs.open_input_file(f"{name}.arrow")
        self.file = pa.ipc.open_file(self.source)
        self.docs = pa.ipc.open_file(fs.open_input_file(f"{name}.docs.arrow"))
        self.length, self.kept = length, (-1, None, None)

    def _batch(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and the packed mask bits of batch ``k``, as views."""
        if self.kept[0] != k:
            batch = self.file.get_batch(k)
            # a batch is a message of its own, so its bits begin at a whole byte
            bits = np.frombuffer(batch.column("mask").flatten().buffers()[1], np.uint8)[: -(-batch.num_rows * self.length // 8)]
            self.kept = k, batch.column("ids").flatten().to_numpy(zero_copy_only=True), bits
        return self.kept[1:]

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Sequence ``i`` of the shard, a view of the file, and its mask, spelled out."""
        k, j = divmod(i, ROWS)
        ids, bits = self._batch(k)
        first, last = j * self.length, (j + 1) * self.length
        mask = np.unpackbits(bits[first // 8 : -(-last // 8)], bitorder="little")[first % 8 :][: self.length]
        return ids[first:last], mask.astype(bool)

    def mask_bits(self, i: int) -> np.ndarray:
        """The mask of sequence ``i`` as a view of the file, eight bits in a byte, the first lowest; for
        lengths that are multiples of 8."""
        if self.length % 8:
            raise ValueError("masks begin at whole bytes only if the length is a multiple of 8")
        k, j = divmod(i, ROWS)
        return self._batch(k)[1][j * self.length // 8 : (j + 1) * self.length // 8]

    def valid(self) -> int:
        """The number of ids that the masks call valid."""
        total = 0
        for k in range(self.file.num_record_batches):
            ids, bits = self._batch(k)
            total += int(np.unpackbits(bits, count=len(ids), bitorder="little").sum())
        return total

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from ``start`` to ``end`` (exclusive) within the shard."""
        size, parts = ROWS * self.length, []
        while start < end:
            k, j = divmod(start, size)
            n = min(end - start, size - j)
            parts.append(self._batch(k)[0][j : j + n])
            start += n
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def read_sequences(spark: SparkSession, folder: str, shards: list[tuple[int, int]], length: int = 2048) -> DataFrame:
    """One row per document, from the files alone: doc_id, start, n_tokens, ids_crc32."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], schema)
    numbers, sizes_of = zip(*shards, strict=True)
    before = np.cumsum([0] + [n for _, n in shards]).tolist()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k in (k for batch in batches for k in batch.column(0).to_pylist()):
            shard = Sequences(folder, numbers[k], length)
            if shard.valid() != sizes_of[k]:
                raise ValueError(f"shard {numbers[k]} has masks of other lengths than its ids")
            for part in (shard.docs.get_batch(i) for i in range(shard.docs.num_record_batches)):
                starts, sizes = (np.asarray(part.column(c)) for c in ("start", "n_tokens"))
                crcs = [zlib.crc32(shard.ids(s, s + n).astype("<u4").tobytes()) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(starts + before[k]), part.column("n_tokens"), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(shards), 1, len(shards)).mapInArrow(read, schema)


def sequence_digest(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents' ids to the shared folder, read the files back and digest them."""
    spark = docs.sparkSession
    folder = shared_path(spark, "sequences")
    return read_sequences(spark, folder, write_sequences(docs, folder, tokenizer, end_id, length, id_col, text_col), length)
