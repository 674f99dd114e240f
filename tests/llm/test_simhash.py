"""op10 against brute force."""

import random

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeframe.llm.near_duplicates import drop_near_duplicates, each_shard, shingle_set
from lodeframe.llm.simhash import BKTree, components, distinct_words, fingerprints, forest, level_masks, links, shard_masks, shingles, simhash_components, word_hashes
from lodeframe.operators.minhash import band_keys, hash_functions, signature


def brute_print(text):
    words = text.lower().split()
    own = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    counts = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in own) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(own))


def brute_roots(values, radius):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from("a B c d é".split()), max_size=9).map(" ".join), max_size=8))
def test_fingerprints(texts):
    texts = [t.encode() for t in texts]
    assert fingerprints(texts, lambda t: shingles(t, 3))[:, 0].tolist() == [brute_print(t) for t in texts]


def near(seed, n, flips):
    random.seed(seed)
    centers = [random.getrandbits(64) for _ in range(8)]
    out = [0, 0]
    for _ in range(n):
        value = random.choice(centers + out)
        for _ in range(random.randint(0, flips)):
            value ^= 1 << random.randrange(64)
        out.append(value)
    return list(dict.fromkeys(out))


def test_tree_and_forest_find_all_links():
    for radius in (0, 2, 3):
        values = near(radius, 150, 4)
        tree = BKTree()
        for v in values:
            tree.add(v)
        for v in values[::7]:
            assert sorted(values[i] for i in tree.within(v, radius)) == sorted(w for w in values if (v ^ w).bit_count() <= radius)
        parent = list(range(len(values)))

        def root(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for i, j in forest(values, radius):
            parent[root(i)] = root(j)
        roots = brute_roots(values, radius)
        assert len({root(i) for i in range(len(values))}) == len(set(roots))


def test_masks_leave_no_link_out():
    random.seed(9)
    for _ in range(300):
        a = random.getrandbits(64)
        b = a
        for _ in range(2):
            b ^= 1 << random.randrange(64)
        masks = shard_masks(2, 10**6, 500)
        assert any((a ^ b) & m == 0 for m in masks.values()) and all(first & whole == first for first, whole in masks.items()) and all(any((a ^ b) & f == 0 for f in level_masks(level, 2)) for level in range(3))


def test_links_with_hot_shards(spark):
    """A limit so small that shards are dealt out again and again."""
    values = near(1, 90, 3)
    nodes = spark.createDataFrame([(k, int(np.uint64(v).astype(np.int64))) for k, v in enumerate(values)], "node long, fp long")
    roots = brute_roots(values, 2)
    for size, limit in ((512, 20), (10, 5), (1, 512)):
        found = components(links(nodes, 2, size, limit))
        got = {r["node"]: r["root"] for r in found.collect()}
        assert [got.get(k, k) for k in range(len(values))] == roots


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_rows(odd, none):
    rows = [(r.doc_id, r.text or "") for r in odd.collect()]
    values = [brute_print(t.encode()) for _, t in rows]
    roots = brute_roots(values, 2)
    expected = []
    for k, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if roots[j] == roots[k] and rows[j][0] is not None]
        expected.append(str((doc_id, f"{values[k]:016x}", min(ids, default=None))))
    assert sorted(map(str, map(tuple, simhash_components(odd).collect()))) == sorted(expected)
    assert simhash_components(none).count() == 0


def test_dropping_keeps_one_of_each_group(spark, odd, none):
    kept = drop_near_duplicates(odd)
    assert kept.schema == odd.schema
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 4, None, 5, 6, 7, 8, 9]))
    assert drop_near_duplicates(none).count() == 0
    random.seed(4)
    base = [f"w{random.randrange(10**6)}" for _ in range(200)]
    copies = []
    for k in range(6):
        words = list(base)
        words[17 * k + 3] = f"new{k}"
        copies.append((10 + k, " ".join(words)))
    others = [(100 + k, " ".join(f"u{random.randrange(10**6)}" for _ in range(80))) for k in range(6)]
    got = drop_near_duplicates(spark.createDataFrame(copies + others + [(None, "a b"), (None, "a b")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1) for r in got) == [-1, 10, 100, 101, 102, 103, 104, 105]


def test_distinct_words():
    assert sorted(distinct_words(b"A a b")) == [b"a", b"b"]


def test_only_texts_that_share_shingles_are_dropped(spark):
    random.seed(6)
    words = [f"w{random.randrange(10**6)}" for _ in range(60)]
    rows = []
    for k in range(12):  # the same words in other orders, every second with a near copy
        random.shuffle(words)
        rows.append((10 * k, " ".join(words)))
        if k % 2:
            rows.append((10 * k + 1, " ".join([*words, "more"])))
    got = sorted(r.doc_id for r in drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [10 * k for k in range(12)]


def test_orders_of_the_same_words_meet_by_their_shingles(spark):
    """All share one fingerprint in every table, far more than a shard may have."""
    random.seed(7)
    words = [f"w{random.randrange(10**6)}" for _ in range(60)]
    rows = []
    for k in range(120):
        random.shuffle(words)
        text = list(words)
        rows.append((10 * k, " ".join(text)))
        if k % 3 == 0:  # the same words, a few of them elsewhere, and one word twice
            rows.append((10 * k + 1, " ".join([*text[1:], text[0]])))
            rows.append((10 * k + 2, " ".join([*text, text[-1]])))
    got = drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), limit=40)
    assert sorted(r.doc_id for r in got.collect()) == [10 * k for k in range(120)]


def test_no_text_is_lost_whatever_the_order(spark):
    random.seed(12)
    a, b, c = (" ".join(f"{k}{random.randrange(10**6)}" for _ in range(30)) for k in "abc")
    for rows in ([(5, b), (5, a), (3, b), (7, c)], [(5, a), (5, b), (7, c), (3, b)]):
        got = drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((r.doc_id, r.text) for r in got) == sorted([(5, a), (3, b), (7, c)])
    rows = [(9, a), (9, b), (9, c + " more"), (9, c), (9, c)]
    kept = [sorted((r.doc_id, r.text) for r in drop_near_duplicates(spark.createDataFrame(x, "doc_id long, text string")).collect()) for x in (rows, rows[::-1])]
    assert kept[0] == kept[1] and len(kept[0]) == 3


def jaccard(x, y):
    x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (x.split(), y.split()))
    return len(x & y) / len(x | y)


def test_groups_of_copies_that_are_alike_only_through_others(spark):
    """Copies of two originals; most pairs of copies are below the threshold."""
    random.seed(5)
    rows = []
    for g in range(2):
        base = [f"w{random.randrange(10**6)}" for _ in range(150)]
        rows.append((1000 * g + 500, " ".join(base)))
        for k in range(40):
            words = list(base)
            for place in random.sample(range(150), 3 if k < 36 else 40):
                words[place] = f"n{random.randrange(10**6)}"
            rows.append((1000 * g + k, " ".join(words)))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i][1], rows[j][1]) >= 0.8:
                parent[root(i)] = root(j)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups[root(k)] = min(i, groups.get(root(k), i))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # a radius at which every pair is met: only the comparisons decide
    for dense in (0, 8, 10**6):
        got = sorted(r.doc_id for r in drop_near_duplicates(docs, radius=24, tables=2, size=10**6, dense=dense).collect())
        assert got == sorted(groups.values())


def test_a_link_does_not_depend_on_how_many_texts_there_are(spark):
    """Near texts of the same words that share no MinHash band, alone and among many other orders of the words."""
    random.seed(8)
    words = [f"w{random.randrange(10**6)}" for _ in range(60)]
    functions, pairs = hash_functions(48), []
    while len(pairs) < 2:
        random.shuffle(words)
        k = random.randrange(20, 40)
        near = [*words[:k], words[k + 1], words[k], *words[k + 2 :]]
        x, y = (band_keys(signature(shingle_set(" ".join(w).encode(), 5), functions), 4) for w in (words, near))
        if not any(a == b for a, b in zip(x, y, strict=True)):
            pairs.append((" ".join(words), " ".join(near)))
    rows = [(10 * i + j, text) for i, pair in enumerate(pairs) for j, text in enumerate(pair)]
    assert all(jaccard(*pair) >= 0.8 for pair in pairs)
    for k in range(40):
        random.shuffle(words)
        rows.append((100 + k, " ".join(words)))
    for n in (4, len(rows)):
        got = sorted(r.doc_id for r in drop_near_duplicates(spark.createDataFrame(rows[:n], "doc_id long, text string"), limit=40).collect())
        assert got == [0, 10, *range(100, 96 + n)]


def test_majorities_of_any_number_of_features():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 4, 5, 63, 64, 65, 1000):
        words = [str(x).encode() for x in rng.integers(0, 1 << 60, n)]
        hashes = [xxhash.xxh64_intdigest(w, 42) for w in words]
        assert fingerprints([b"", b" ".join(words)], bytes.split).tolist() == [[0], [sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)]]


def test_word_hashes():
    rng = random.Random(4)
    texts = [b"", b" ", b"a", b" A b ", bytes(range(256)), b"\x1c\x1d x\x85y\xa0z\x00", b" ".join(b"x" * n for n in range(1, 70))]
    texts += [bytes(rng.choice(b"aB\xc3 \t\n\x0b") for _ in range(rng.randrange(60))) for _ in range(100)]
    assert [x.tolist() for x in word_hashes(texts)] == [[xxhash.xxh64_intdigest(w, 42) for w in t.lower().split()] for t in texts]
    assert word_hashes([]) == [] and [x.tolist() for x in word_hashes([b""])] == [[]]


def test_shingle_sets_follow_the_shingles():
    rng = random.Random(6)
    texts = [b" ".join(rng.choices([b"a", b"B", b"b", b"c"], k=n)) for n in range(12) for _ in range(20)]
    digests = [shingle_set(t, 5).tolist() for t in texts]
    assert all(x == sorted(set(x)) and len(x) == len(set(shingles(t, 5))) for t, x in zip(texts, digests, strict=True))
    for t, x in zip(texts, digests, strict=True):
        assert [set(shingles(t, 5)) == set(shingles(u, 5)) for u in texts] == [x == y for y in digests]


def test_shards_hold_only_what_is_still_open():
    """Nodes near others of their own component only are left out; the pairs still open are all there, in small and large shards."""
    rng = random.Random(7)
    for n, roots in ((20, 1), (20, 3), (100, 4), (300, 1), (300, 5)):
        rows = []
        for bits in range(4):
            centre = rng.getrandbits(64)
            for k in range(n):
                fp = centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice((0, 1, 2, 9))))
                rows.append((0, 1, bits, fp - (1 << 64) if fp >> 63 else fp, 1000 * bits + k, 1, rng.randrange(roots)))
        columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
        whole = pa.RecordBatch.from_arrays(columns, ["t", "mask", "bits", "fp", "node", "size", "root"])
        got = [(key, set(shard.pairs(0.8))) for key, shard in each_shard((whole.slice(k, 37) for k in range(0, len(rows), 37)), 3)]
        by = {bits: [r for r in rows if r[2] == bits] for bits in range(4)}
        wanted = {bits: {(y[4], x[4]) for i, y in enumerate(own) for x in own[:i] if y[6] != x[6] and ((y[3] ^ x[3]) & (1 << 64) - 1).bit_count() <= 3} for bits, own in by.items()}
        assert {key[2]: pairs for key, pairs in got} == {bits: pairs for bits, pairs in wanted.items() if pairs}
        assert (roots == 1) == (not got)
