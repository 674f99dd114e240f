"""op2 against DuckDB, op5's dynamic program against all partitions, op1's selection by sorting."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash

from lodeframe.llm.licenses import TEMPLATES, license_scan, oracle_sql, signature, template_bigrams
from lodeframe.llm.packing import bucket_bounds, pack
from lodeframe.llm.resampling import _top, importance_resample
from tokenizers import Tokenizer


def test_license_scan_equals_sql_without_pruning(spark, odd, none):
    random.seed(1)
    rows = []
    for name, text in TEMPLATES.items():
        words = text.split()
        for drop in (0, 1, len(words) // 4):
            kept = [w for k, w in enumerate(words) if k not in random.sample(range(len(words)), drop)]
            rows.append((len(rows), f"Prose before.\n{' '.join(kept)}\n\nMore\nlines"))
        rows.append((len(rows), text.upper().replace(" ", " \n ")))
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    documents = df.toArrow()  # noqa: F841  read by the SQL
    key = lambda r: (str(r[0]), r[1], r[2], r[3], round(r[4], 9))
    expected = sorted(map(key, duckdb.sql(oracle_sql()).project("doc_id, kind, number, license, dice").fetchall()))
    got = sorted(key((r.doc_id, r.kind, r.number, r.license, r.dice)) for r in license_scan(df).collect())
    assert got == expected and len({r[3] for r in got}) == len(TEMPLATES)
    assert license_scan(none).count() == 0


def test_whole_licences_and_headers_above_code_are_found(spark):
    code = "\n" + "\n".join(f"int f{k}(int x) {{ return x + {k}; }}" for k in range(60))
    comment = lambda text: "\n".join("# " + " ".join(text.split()[k : k + 9]) for k in range(0, len(text.split()), 9))
    clauses = lambda text: re.sub(r" (?=(?:[123]\\. |THIS SOFTWARE))", "\n\n", text)
    rows = [(name, "Copyright (c) 2020 A. Body\n\n" + clauses(TEMPLATES[name]) + "\n\nfurther text " * 50) for name in TEMPLATES if name.endswith(("-full", "-text"))]
    rows += [(name, comment(TEMPLATES[name]) + code) for name in ("Apache-2.0-header", "GPL-3.0-or-later", "LGPL-3.0-or-later", "MPL-2.0")]
    rows += [("GPL-3.0-or-later", TEMPLATES["GPL-3.0-or-later"].replace(" ", "\n ") + " word" * 200), ("MIT-notice", "Some words first. Released under the MIT License. And some after it, in one line."), ("All-rights-reserved", "(c) 2020 somebody\nAll rights reserved.\nmore")]
    got = license_scan(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()
    for k, (name, _) in enumerate(rows):
        assert name in {r.license for r in got if r.doc_id == k}, name


@pytest.mark.parametrize("inserted", [6, 12, 20])
def test_words_inserted_all_over_a_licence_do_not_hide_it(spark, inserted):
    """The whole text on one line among others: its best window is found, however many pieces it is in."""
    words = TEMPLATES["BSD-3-Clause-full"].split()
    for k in range(inserted):
        words.insert((k + 1) * len(words) // (inserted + 1), f"extra{k}")
    text = " ".join([*(f"before{k}" for k in range(200)), *words, *(f"after{k}" for k in range(200))])
    found = {r.license: (r.number, r.dice) for r in license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect() if r.kind == "window"}
    w, b = re.sub(r"[\W_]+", " ", text.lower()).split(), set(template_bigrams(TEMPLATES["BSD-3-Clause-full"]))
    n = len(re.sub(r"[\W_]+", " ", TEMPLATES["BSD-3-Clause-full"]).split())
    cut = lambda i: {" ".join(x) for v in [w[i : i + n]] for x in zip(v, v[1:], strict=False)}
    best = max((2 * len(cut(i) & b) / (len(cut(i)) + len(b)), -i) for i in range(len(w)))
    assert found.get("BSD-3-Clause-full") == ((-best[1], pytest.approx(best[0])) if best[0] >= 0.8 else None)
    assert inserted > 12 or "BSD-3-Clause-full" in found


def test_clashing_columns_and_ties(spark, odd):
    assert license_scan(odd).columns == ["doc_id", "kind", "number", "license", "dice"]
    same = {"B": "one two three four", "A": "one two three four"}
    got = license_scan(spark.createDataFrame([(1, "one two three four")], "doc_id long, text string"), same).collect()
    assert sorted((r.kind, r.license) for r in got) == [("line", "A"), ("window", "A"), ("window", "B")]


def test_signatures_meet_more_bigrams_than_may_lack():
    for text in TEMPLATES.values():
        bigrams = template_bigrams(text)
        met = {b for b in bigrams if set(b.split()) & signature(bigrams, 0.8)}
        assert len(bigrams) - len(met) < len(bigrams) * 0.8 / 1.2


def test_bounds_are_optimal():
    random.seed(1)
    for _ in range(100):
        m, k = random.randint(1, 8), random.randint(1, 4)
        lengths, counts = np.array(sorted(random.sample(range(1, 40), m))), np.array([random.randint(1, 9) for _ in range(m)])
        cost = lambda bounds: sum(c * min(b for b in bounds if b >= x) for x, c in zip(lengths, counts, strict=True))  # noqa: B023, E731
        best = min(cost([*x, lengths[-1]]) for q in range(min(k, m)) for x in itertools.combinations(lengths[:-1], q))
        bounds = bucket_bounds(lengths, counts, k)
        assert len(bounds) <= k and cost(bounds) == best
    assert bucket_bounds(np.zeros(0, np.int64), np.zeros(0, np.int64), 3) == []


@pytest.mark.parametrize("tokenizer", [None, public_tokenizers.path("word_bpe_49k.json")])
def test_pack(odd, none, tokenizer):
    count = (lambda t: len(t.split())) if tokenizer is None else (lambda t: len(Tokenizer.from_file(tokenizer).encode(t, add_special_tokens=False).ids))
    rows = pack(odd, tokenizer, n_buckets=3, max_length=16, token_budget=64).collect()
    sizes = sorted((str(r.doc_id), count(r.text or "") + 1) for r in odd.collect())
    total = {}
    for r in rows:
        total[str(r.doc_id)] = total.get(str(r.doc_id), 0) + r.n_tokens
        assert r.n_tokens <= min(r.bucket_length, 16) and r.slot < 64 // r.bucket_length
    wanted = {}
    for i, n in sizes:
        wanted[i] = wanted.get(i, 0) + n
    assert total == wanted
    assert len({r.bucket_length for r in rows}) <= 3
    places = [(r.bucket_length, r.batch, r.slot) for r in rows]
    assert len(set(places)) == len(places)
    for length in {p[0] for p in places}:  # only the last batch may be short
        own = sorted(b * (64 // length) + s for n, b, s in places if n == length)
        assert own == list(range(len(own)))
    assert pack(none, tokenizer).count() == 0


def test_resampling(spark, odd, none):
    random.seed(2)
    good = [(k, " ".join(random.choice(["river", "stone", "light", "field"]) for _ in range(30)), 1, 0) for k in range(60)]
    bad = [(100 + k, " ".join(random.choice(["###", "$$$", "junk"]) for _ in range(30)), 0, 0) for k in range(40)]
    rows = spark.createDataFrame(good + bad, "doc_id long, text string, quality int, toxic int")
    labels = rows.where("doc_id % 3 = 0").select("doc_id", "quality", "toxic").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS doc_id, 1 AS quality, CAST(NULL AS INT) AS toxic"))
    got = importance_resample(rows.select("doc_id", "text"), labels, share=0.6).collect()
    assert {r.doc_id for r in got if r.kept} == set(range(60))
    for share in (0.0, 0.37, 1.0):
        got = importance_resample(rows.select("doc_id", "text"), labels, share=share).collect()
        wanted = sorted(got, key=lambda r: -r.key)[: round(100 * share)]
        assert {r.doc_id for r in got if r.kept} == {r.doc_id for r in wanted}
    everything = importance_resample(odd, labels.limit(0)).collect()
    assert len(everything) == odd.count() and all(r.kept and r.log_weight == 0 and math.isfinite(r.key) for r in everything)
    assert importance_resample(none, labels).count() == 0


def plain_features(text, buckets):
    words = [zlib.crc32(w) for w in text.lower().split()]
    for k, w in enumerate(words):
        yield w % buckets
        if k + 1 < len(words):
            mixed = (w * 0x9E3779B97F4A7C15 ^ words[k + 1] + 0x7F4A7C15) % 2**64
            yield ((mixed ^ mixed >> 29) * 0xBF58476D1CE4E5B9 % 2**64 >> 20) % buckets


def test_weights_and_keys_by_definition(spark):
    random.seed(9)
    texts = [(k, " ".join(random.choice("a B c d e É river, stone".split()) for _ in range(random.randint(0, 25)))) for k in range(120)] + [(None, "no id"), (500, "long " * 30_000)]
    labels = [(k, int(k % 3 > 0), int(k % 7 == 0)) for k in range(0, 120, 2)]
    good, buckets = {k for k, q, t in labels if q and not t}, 256
    raw, target = Counter(), Counter()
    for i, t in texts:
        own = Counter(plain_features(t.encode(), buckets))
        raw += own
        if i in good:
            target += own
    ratio = [math.log((target[b] + 1) / (sum(target.values()) + buckets)) - math.log((raw[b] + 1) / (sum(raw.values()) + buckets)) for b in range(buckets)]
    docs, marks = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in importance_resample(docs, marks, buckets=buckets).collect()}
    for i, t in texts:
        own = list(plain_features(t.encode(), buckets))
        uniform = ((xxhash.xxh64_intdigest(f"{i}\0".encode() + t.encode(), 42) >> 11) + 0.5) / 2.0**53
        weight = sum(ratio[b] for b in own)
        assert got[i].n_features == len(own) and math.isclose(got[i].log_weight, weight, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(got[i].key, weight - math.log(-math.log(uniform)), rel_tol=1e-9, abs_tol=1e-9)
    wanted = round(len(texts) * len(good) / len(labels))
    assert {i for i, r in got.items() if r.kept} == {r.doc_id for r in sorted(got.values(), key=lambda r: -r.key)[:wanted]}


def test_ties_at_the_last_place(spark):
    rows = [(k, 1, 0.0, 1.0, 7, 0) for k in (5, 3, None, 9, 4)] + [(1, 1, 0.0, 2.0, 8, 0), (0, 1, 0.0, 0.0, 6, 0)]
    df = spark.createDataFrame(rows, "doc_id long, n_features long, log_weight double, key double, place long, draw long")
    for k, kept in ((1, {1}), (2, {1, 3}), (4, {1, 3, 4, 5}), (6, {1, 3, 4, 5, 9, None}), (7, {1, 3, 4, 5, 9, None, 0})):
        assert {r.doc_id for r in _top(df, k).collect() if r.kept} == kept
