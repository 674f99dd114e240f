"""MinHash bands against the exact Jaccard similarity of all pairs."""

import random

import numpy as np
import pytest

from lodeframe.operators import minhash
from lodeframe.operators.minhash import band_keys, hash_functions, jaccard, near_duplicate_classes, shingle_hashes, signature

SCHEMA = "doc_id long, text string, class_id string, node int"


def by_definition(rows, threshold=0.8):
    sets = [shingle_hashes(t, 5) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= threshold:
                root[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    return sorted(((doc_id, least.get(top(i))) for i, (doc_id, _) in enumerate(rows)), key=str)


def classes(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in near_duplicate_classes(docs, **options).collect()), key=str)


def families(seed, n, copies, changes):
    """Texts and copies of them with some words changed: similarities on both sides of 0.8."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    out = []
    for _ in range(n):
        own = [word() for _ in range(rng.randrange(60, 200))]
        for _ in range(copies):
            text = list(own)
            for _ in range(rng.randrange(changes)):
                text[rng.randrange(len(text))] = word()
            out.append(" ".join(text))
    return out


def test_classes_are_those_of_all_pairs(spark, monkeypatch):
    # blocks so small that buckets fall into many
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rows = list(enumerate(families(1, 12, 15, 12) + families(2, 40, 1, 1)))
    rows += [(0, rows[0][1]), (None, rows[1][1]), (900, None), (901, ""), (902, " \t"), (903, "one two"), (904, "One TWO"), (None, "quite alone")]
    assert classes(spark, rows) == by_definition(rows)


def test_recall_of_links_at_the_threshold():
    # pairs of 0.8 to 0.9: the share that is in one bucket at least
    rng = random.Random(3)
    functions, found, n = hash_functions(128), 0, 0
    while n < 400:
        a, b = ([f"w{rng.random()}" for _ in range(150)] for _ in range(2))
        b = a[: rng.randrange(135, 145)] + b[:8]
        x, y = (shingle_hashes(" ".join(t), 5) for t in (a, b))
        if 0.8 <= jaccard(x, y) < 0.9:
            n += 1
            found += bool(set(zip(range(32), band_keys(signature(x, functions), 4), strict=True)) & set(zip(range(32), band_keys(signature(y, functions), 4), strict=True)))
    assert found == n


def test_signatures_estimate_the_similarity():
    functions = hash_functions(128)
    x = np.arange(3000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shared in (0, 1500, 2700):
        y = np.concatenate([x[:shared], x[shared:] + np.uint64(7)])
        assert abs((signature(x, functions) == signature(y, functions)).mean() - jaccard(np.sort(x), np.sort(y))) < 0.15
    assert (signature(x[:0], functions) == 0xFFFFFFFF).all()


@pytest.mark.parametrize("block", [16, 256])
def test_a_common_bucket_is_shared_out(spark, monkeypatch, block):
    # one family below the threshold: all share buckets, most are no links
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = list(enumerate(families(4, 1, 120, 30)))
    assert classes(spark, rows) == by_definition(rows)


def test_without_rows(spark):
    assert near_duplicate_classes(spark.createDataFrame([], SCHEMA)).count() == 0
