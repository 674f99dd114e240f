"""op9 and op7 against the library itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import TEXTS  # noqa: F401
from tokenizers import Tokenizer

from lodeframe.llm import vocab
from lodeframe.llm.sequence_files import Sequences, encoded, read_sequences, sequence_digest, write_sequences
from lodeframe.llm.token_counts import token_counts
from lodeframe.storage import shared_path

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def library_ids(path, text):
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).encode(text)
    return Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_encoded_equals_library_on_odd_strings():
    random.seed(5)
    parts = list("aAbBhHxX'’sStTrReE.,!?&#$<|>12 \n\t") + ["ţ", "̱", "́", "é", "É", "ß", "İ", "ı", "Σ", "ς", "中", "한", " ", " ", "…", "€", "\x00", "ẖ", "<|endoftext|>", "<|startoftext|>", "'ll", "don't ", "THE. "]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 25))) for _ in range(3000)]
    tokenizer = Tokenizer.from_file(WORDS)
    ids, lengths = encoded(pa.array([t.encode() for t in texts]), WORDS, 1)
    at = np.concatenate([[0], np.cumsum(lengths)])
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids + [1], t


def test_encoded_takes_slices_nulls_and_large_strings():
    column = pa.array(["cut off", "Hello, World!", None, " ", "a.b, c"], pa.large_string()).slice(1, 3)
    library = Tokenizer.from_file(WORDS)
    ids, lengths = encoded(column, WORDS, 1)
    hello = library.encode("Hello, World!", add_special_tokens=False).ids
    assert ids.tolist() == hello + [1, 1, 1] and lengths.tolist() == [len(hello) + 1, 1, 1]
    assert [len(x) for x in encoded(column.slice(0, 0), WORDS, 1)] == [0, 0]


def test_only_word_tokenizers_are_cut_at_white_space():
    assert vocab.drops_white_space(WORDS) and not vocab.drops_white_space(BYTES) and not vocab.drops_white_space(PIECES)


@pytest.mark.parametrize("path", [WORDS, BYTES, PIECES])
def test_token_counts(odd, path):
    got = sorted(map(str, ((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(odd, path).collect())))
    expected = [(r.doc_id, len((r.text or "").encode()), n := len(library_ids(path, r.text or "")), n > 2048) for r in odd.collect()]
    assert got == sorted(map(str, expected))


def test_empty_table(none):
    assert token_counts(none, WORDS).count() == 0 and sequence_digest(none, WORDS).count() == 0


@pytest.mark.parametrize("length", [4, 2048])
def test_sequence_files(odd, length):
    rows = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(sequence_digest(odd, WORDS, length=length).collect(), key=lambda r: r["start"])
    start = 0
    for (doc_id, text), r in zip(rows, got, strict=True):
        ids = library_ids(WORDS, text) + [1]
        assert tuple(r) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_random_access_and_masks(spark, odd):
    folder = shared_path(spark, "sequences")
    shards = write_sequences(odd, folder, WORDS, length=16)
    for shard, n in shards:
        opened = Sequences(folder, shard, 16)
        flat, valid = [], 0
        for i in range(-(-n // 16)):
            ids, mask = opened.sequence(i)
            assert len(ids) == len(mask) == 16
            flat += ids.tolist()
            valid += int(mask.sum())
        assert valid == n and flat[:n] == opened.ids(0, n).tolist()


def test_many_shards_and_views(spark, odd):
    folder = shared_path(spark, "sequences")
    shards = write_sequences(odd, folder, WORDS, length=16, shard_ids=50)
    assert len(shards) > 3
    for shard, n in shards:
        opened = Sequences(folder, shard, 16)
        assert opened.valid() == n
        ids, mask = opened.sequence(0)
        assert not ids.flags.owndata and not opened.mask_bits(0).flags.owndata and not opened.mask_bits(0).flags.writeable
        assert (np.unpackbits(opened.mask_bits(0), bitorder="little").astype(bool) == mask).all()
    whole = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in sequence_digest(odd, WORDS).collect()]
    parts = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in read_sequences(spark, folder, shards, 16).collect()]
    assert sorted(map(str, whole)) == sorted(map(str, parts))


def test_bytes_that_are_not_utf8():
    texts = [b"\xff\xfe word", b"w\xc3", b"ok"]
    library = Tokenizer.from_file(WORDS)
    wanted = [len(library.encode(t.decode(errors="replace"), add_special_tokens=False).ids) for t in texts]
    assert vocab.encode(WORDS, texts[1:])[1].tolist() == wanted[1:] and (encoded(pa.array(texts), WORDS, 1)[1] - 1).tolist() == wanted
