import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lodeframe.llm.crc_resampling import WordCrcs, combined, crc_resample, features

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs_of(text, longest):
    words = WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    return words, [b" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def by_definition(docs, target, longest, buckets, least_words, percent):
    raw = Counter(zlib.crc32(x) % buckets for _, t in docs for x in runs_of(t, longest)[1])
    wanted = Counter(zlib.crc32(x) % buckets for t in target for x in runs_of(t, longest)[1])
    s_all, t_all = sum(raw.values()), sum(wanted.values())
    out = []
    for i, text in docs:
        words, found = runs_of(text, longest)
        each = [math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((raw[b] + 1) * (t_all + buckets)))) for b in (zlib.crc32(x) % buckets for x in found)]
        weight = sum(each) // len(each) if each else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words) >= least_words])
    may = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(may[: percent * len(may) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_crcs_are_combined():
    rng = random.Random(1)
    pairs = [(rng.randbytes(rng.randrange(40)), rng.randbytes(rng.choice([0, 1, 2, 7, 255, 256, 70_000]))) for _ in range(200)]
    first, second = (np.array([zlib.crc32(x[k]) for x in pairs], np.uint32) for k in (0, 1))
    assert combined(first, second, np.array([len(b) for _, b in pairs])).tolist() == [zlib.crc32(a + b) for a, b in pairs]


@pytest.mark.parametrize("longest", [1, 2, 3, 5])
def test_features_of_all_runs(longest):
    texts = ["", "One two, THREE four_five 6", "a", "x y", None, "naïve Ünï 中文 b", "w " * 50, "long" * 5000 + " end"]
    found, offsets, n_words = features([(t or "").encode() for t in texts], longest, 1 << 31, WordCrcs())
    for k, t in enumerate(texts):
        words, runs = runs_of(t, longest)
        assert sorted(found[offsets[k] : offsets[k + 1]].tolist()) == sorted(zlib.crc32(x) % (1 << 31) for x in runs)
        assert n_words[k] == len(words)


@pytest.mark.parametrize("longest", [1, 3])
def test_against_the_definition(spark, longest):
    rng = random.Random(2)
    text = lambda: " ".join(f"w{rng.randrange(90)}" for _ in range(rng.randrange(60)))
    docs = [(i, text()) for i in range(300)]
    docs += [(3, docs[3][1])] * 4 + [(None, text()), (None, None), (400, None), (401, ""), (402, "," * 30)]
    target = [text().replace("w1", "w2") for _ in range(20)] + [None, ""]
    got = crc_resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([(t,) for t in target], "text string"), longest, 97, least_words=20, percent=30)
    want = by_definition(docs, target, longest, 97, 20, 30)
    # equal rows share their ranks in any order
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert sum(r[4] is not None for r in want) > 50


def test_odd_rows(odd, none):
    got = crc_resample(odd, odd, percent=100, least_words=1).collect()
    assert len(got) == odd.count()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 10))
    assert {r["weight"] for r in got if r.doc_id in (2, 3)} == {0}
    assert crc_resample(none, odd).count() == 0
    assert crc_resample(odd, none).where("rank IS NOT NULL").count() == 0
