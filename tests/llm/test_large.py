"""Several blocks to a task, and a text of 120,000 words."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodeframe.llm import blocks
from lodeframe.llm.crc_resampling import crc_resample
from lodeframe.llm.licenses import TEMPLATES, license_scan
from lodeframe.llm.packing import pack
from lodeframe.llm.pii import mask_pii, pii_spans
from lodeframe.llm.recompression import repeated_passages
from lodeframe.llm.repetition import repetition
from lodeframe.llm.simhash import simhash_components
from lodeframe.llm.tiling import contaminated
from lodeframe.llm.token_counts import token_counts

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_counts_over_several_blocks(spark, odd, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 300)
    monkeypatch.setattr(blocks, "PACKED", 20)
    monkeypatch.setattr(blocks, "LANES", 7)
    rng = random.Random(1)
    more = [(100 + k, " ".join(rng.choice(["the", "naïve", "x1", "Ünï", "word,", "\U0001f600"]) for _ in range(rng.randrange(60)))) for k in range(80)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")).coalesce(2)
    library = Tokenizer.from_file(WORDS)
    want = sorted(((r["doc_id"], len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect()), key=str)
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in token_counts(docs, WORDS).collect()), key=str) == want
    packed = pack(docs, WORDS).collect()
    assert len(packed) > 0


@pytest.fixture(scope="module")
def long(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(200_000)}" for _ in range(120_000)]
    passage = words[1000:1100]
    text = " ".join([*words[:60_000], "mail", "a.b@c.de", *TEMPLATES["ISC-full"].split(), *words[60_000:], *passage])
    assert len(text) > 800_000
    return spark.createDataFrame([(1, text), (2, " ".join(passage)), (3, "short")], "doc_id long, text string"), text


def test_a_long_text_is_taken_whole(spark, long):
    docs, text = long
    n = len(text.split())
    counts = {r["doc_id"]: r for r in repetition(docs).collect()}
    assert counts[1]["n_words"] == n and counts[1]["n_repeat_words"] == 200
    removed = {r["doc_id"]: r for r in repeated_passages(docs).collect()}
    assert [removed[i]["n_removed"] for i in (1, 2, 3)] == [200, 100, 0]
    assert removed[1]["n_words"] == n and removed[1]["kept_text"].split()[-1] != text.split()[-1]
    assert {r["doc_id"]: r["n_features"] for r in crc_resample(docs, docs).collect()}[2] == 100
    assert len({r["fingerprint"] for r in simhash_components(docs).collect()}) == 3
    assert ("ISC-full", 1) in {(r["license"], r["doc_id"]) for r in license_scan(docs).collect()}
    item = spark.createDataFrame([(9, " ".join(text.split()[90_000:90_040]))], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in contaminated(docs, item).collect()} == {(1, 9)}


def test_personal_data_late_in_a_long_text(long):
    docs, text = long
    at = text.index("a.b@c.de")
    assert {r["doc_id"]: r["spans"] for r in pii_spans(docs).collect()} == {1: f"email:{at}:{at + 8}", 2: "", 3: ""}
    assert {r["doc_id"]: r["text"] for r in mask_pii(docs).collect()}[1] == text.replace("a.b@c.de", "<email>")
