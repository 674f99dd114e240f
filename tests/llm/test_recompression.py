import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lodeframe.llm import recompression
from lodeframe.llm.recompression import Fingerprints, levels, long_symbols, removal_digest, repeated_passages, short_symbols


def by_definition(texts, window):
    """(n_words, n_removed, words kept) of each text."""
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def results(spark, texts, window):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return [tuple(r)[1:] for r in sorted(repeated_passages(docs, window).collect())]


def corpus(seed, n=60, vocabulary=400):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    passages = [[word() for _ in range(rng.randrange(8, 120))] for _ in range(8)]
    out = []
    for _ in range(n):
        words = [word() for _ in range(rng.randrange(0, 80))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            words += p[a : a + rng.randrange(len(p))] + [word() for _ in range(rng.randrange(12))]
        if rng.random() < 0.2:
            words += [word()] * rng.randrange(60)
        if rng.random() < 0.2:
            words += [word(), word()] * rng.randrange(40)
        out.append(" ".join(words))
    return out + out[:5] + [None, "", " \n", passages[0][0]]


@pytest.mark.parametrize(("seed", "window", "vocabulary"), [(1, 35, 400), (2, 12, 400), (3, 20, 3), (4, 35, 2)])
def test_removes_what_the_definition_removes(spark, monkeypatch, seed, window, vocabulary):
    # several blocks to a task, several slices to a block
    monkeypatch.setattr(recompression, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(recompression, "SLICE_BYTES", 900)
    texts = corpus(seed, vocabulary=vocabulary)
    assert results(spark, texts, window) == by_definition(texts, window)


def test_a_copy_cut_elsewhere_finds_its_partner(spark):
    # two copies of a long passage are proven by their symbols, the third is cut so that it shares none of them
    rng = random.Random(5)
    passage = [f"p{rng.randrange(10**6)}" for _ in range(300)]
    texts = [" ".join(passage), " ".join(["x", *passage, "y"])]
    texts += [" ".join(["a", *passage[k : k + 35], "b"]) for k in range(0, 265, 7)]
    assert results(spark, texts, 35) == by_definition(texts, 35)
    assert all(n - gone <= 2 for n, gone, _ in results(spark, texts, 35))


def test_windows_are_judged_on_the_input(spark):
    run = " ".join(["same"] * 36)
    assert results(spark, [run, "same " * 34], 35) == [(36, 36, ""), (34, 0, " ".join(["same"] * 34))]


def test_equal_passages_have_equal_symbols_where_they_depend_on_nothing_else():
    rng = np.random.default_rng(6)
    shared = rng.integers(1 << 63, size=400).astype(np.uint64)
    shared[100:140] = shared[100]
    for _ in range(20):
        before, after = (rng.integers(1 << 63, size=int(rng.integers(50))).astype(np.uint64) for _ in range(2))
        words = np.concatenate([before, shared, after])
        offsets = np.array([0, len(words)])
        alone = {(x, s, e) for part, _ in levels(shared, np.array([0, 400])) for x, s, e, low, high in zip(part.name, part.start, part.end, part.low, part.high, strict=True) if low >= 0 and high <= 400}
        inside = {(x, s - len(before), e - len(before)) for part, _ in levels(words, offsets) for x, s, e, low, high in zip(part.name, part.start, part.end, part.low, part.high, strict=True) if low >= len(before) and high <= len(before) + 400}
        assert len(alone) > 300
        assert alone <= {(x, s - len(before), e - len(before)) for part, _ in levels(words, offsets) for x, s, e in zip(part.name, part.start, part.end, strict=True)}
        assert inside <= {(x, s, e) for part, _ in levels(shared, np.array([0, 400])) for x, s, e in zip(part.name, part.start, part.end, strict=True)}


def test_a_text_ends_as_one_symbol_of_all_its_words():
    rng = np.random.default_rng(7)
    words = rng.integers(1 << 63, size=3000).astype(np.uint64)
    offsets = np.array([0, 1000, 1000, 3000])
    x = long_symbols(words, offsets, 35)
    assert {(0, 1000), (1000, 3000)} <= set(zip(x.start.tolist(), x.end.tolist(), strict=True))
    short = short_symbols(words, offsets)
    order = np.argsort(short.start)
    assert (short.start[order][1:] >= short.end[order][:-1]).all()
    assert short.sizes().sum() > 0.5 * len(words)


def test_fingerprints_depend_on_the_words_only():
    rng = np.random.default_rng(8)
    words = rng.integers(1 << 63, size=200).astype(np.uint64)
    words[100:150] = words[20:70]
    a, b = Fingerprints(words).of(np.arange(165), np.arange(35, 200))
    assert (a[100:116] == a[20:36]).all() and (b[100:116] == b[20:36]).all()
    assert len(set(zip(a.tolist(), b.tolist(), strict=True))) == 165 - 16


def test_odd_rows(odd, none):
    assert {r.kept_text for r in repeated_passages(odd).where("n_words > 48").collect()} == {""}
    rows = {(r.doc_id, r.n_words): r for r in removal_digest(odd).collect()}
    assert rows[3, 0].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert (rows[8, 3000].n_removed, rows[1, 48].n_removed) == (3000, 48)
    assert rows[4, 30].n_removed == 0 and rows[None, 12].n_removed == 0
    assert removal_digest(odd).count() == odd.count()
    assert removal_digest(none).count() == 0
