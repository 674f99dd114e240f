"""op3: the base against a plain count, the tree against a plain one."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodeframe.llm.suffix_tree_lm import Places, counted, suffix_tree_scores, train_suffix_tree

DEPTH, SHARE, DIVERGENCE = 3, 0.002, 2.0


def stream(text):
    return b" ".join((text or "").encode().lower().split()) + b"\n"


class PlainTree:
    """The same model with dictionaries."""

    def __init__(self, texts):
        self.counts = defaultdict(Counter)
        total = 0
        for text in texts:
            s = b"\n" + stream(text)
            for i in range(1, len(s)):
                total += 1
                for d in range(min(DEPTH, i) + 1):
                    self.counts[s[i - d : i]][s[i]] += 1
        frequent = {c: n for c, n in self.counts.items() if not c or sum(n.values()) >= SHARE * total}
        seen = {c[0] for c in frequent if len(c) == 1} | {10}
        # bytes that are no candidate share one symbol
        self.symbol = lambda b: b if b in seen else -1
        self.counts = {}
        for c, n in frequent.items():
            own = Counter()
            for b, k in n.items():
                own[self.symbol(b)] += k
            self.counts[c] = own
        self.memo = {}
        self.kept = {b""}
        for c in sorted(self.counts, key=len):
            if c:
                gain = sum(n * math.log(self.p(c, b) / self.p(c[1:], b)) for b, n in self.counts[c].items())
                if gain > DIVERGENCE:
                    self.kept |= {c[k:] for k in range(len(c))}

    def p(self, c, b):
        if (c, b) not in self.memo:
            below = self.p(c[1:], b) if c else 1 / 256
            n = self.counts[c]
            self.memo[c, b] = (n[b] + len(n) * below) / (sum(n.values()) + len(n))
        return self.memo[c, b]

    def score(self, text):
        s, total = b"\n" + stream(text), 0.0
        for i in range(1, len(s)):
            c = next(s[i - d : i] for d in range(min(DEPTH, i), -1, -1) if s[i - d : i] in self.kept)
            total += math.log10(self.p(c, self.symbol(s[i])))
        return total


@pytest.fixture(scope="module")
def texts():
    random.seed(3)
    words = ["the", "of", "tion", "Ärger", "éa", "no\x00ne", "a", "x" * 40]
    return [" ".join(random.choice(words) + random.choice(["", ",", "s"]) for _ in range(random.randint(0, 60))) for _ in range(60)] + ["", "zq " * 900]


def test_tree(spark, texts):
    tree = train_suffix_tree(spark.createDataFrame([(t,) for t in texts], "text string"), DEPTH, SHARE, DIVERGENCE)
    plain = PlainTree(texts)
    checked = [t for t in texts if "\x00" not in t] + ["never seen QX ∑", "the of"]
    got = tree.scores([t.encode().lower().split() for t in checked])
    # a zero byte is spelled as a tab in the tree, which changes no count of other contexts
    assert np.allclose(got, [plain.score(t) for t in checked], rtol=2e-4)
    assert tree.n_retained == len(plain.kept)


def test_rows(spark, odd, none):
    got = suffix_tree_scores(odd, depth=4, least_share=1e-3).collect()
    rows = [(r.doc_id, (r.text or "").encode().lower().split() + [None]) for r in odd.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, words in rows if not held(i) for w in words)
    n, v = sum(counts.values()), len(counts)
    expected = Counter((str(i), held(i), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 4)) for i, w in rows)
    assert Counter((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == expected
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert suffix_tree_scores(none, depth=2).count() == 0


def test_held_out_texts_score_above_the_base(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 6000")
    got = suffix_tree_scores(rows).where("held_out").selectExpr("sum(score) AS s", "sum(base_score) AS b").first()
    assert got["s"] > got["b"]


def test_a_rare_context_is_kept_however_large_the_rest(spark):
    """A pattern seen a few times among so many symbols that its share is far below any fixed one."""
    random.seed(8)
    words = ["".join(random.choice("etaoinsr") for _ in range(random.randint(2, 7))) for _ in range(400)]
    bulk = [" ".join(random.choice(words) for _ in range(2000)) for _ in range(120)]
    rows = [(k, t) for k, t in enumerate(bulk)] + [(None, "qqzvkqj")] * 3
    asked = next(k for k in range(1000, 2000) if zlib.crc32(str(k).encode()) % 7 == 2)
    got = suffix_tree_scores(spark.createDataFrame([*rows, (asked, "qqzvkqj")], "doc_id long, text string")).where(f"doc_id = {asked}").first()
    assert got["held_out"]
    # its symbols after the first follow contexts seen three times, always with the same next symbol
    assert got["score"] > -5.5


def test_probabilities_of_rare_bytes_add_up(spark):
    """Bytes that are each below the share have their own probabilities, not all their sum."""
    spelt = [bytes([b]) for b in range(33, 127) if not 65 <= b <= 90]
    tree = train_suffix_tree(spark.createDataFrame([(w.decode(),) for w in spelt], "text string"), 2, 0.05, 2.0)
    every = [[bytes([b])] for b in range(1, 256) if bytes([b]).lower().split() == [bytes([b])]]
    assert sum(10.0 ** tree.scores(every)) <= 1


def test_scores_of_the_table_are_those_in_memory(spark, texts):
    rows = [(k, t) for k, t in enumerate(texts)]
    held = lambda k: zlib.crc32(str(k).encode()) % 7 == 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in suffix_tree_scores(docs, depth=5, divergence=-math.inf).collect()}
    tree = train_suffix_tree(spark.createDataFrame([(t,) for k, t in rows if not held(k)], "text string"), 5, 0.0, -math.inf)
    assert any(map(held, got)) and np.allclose([got[k] for k, _ in rows], tree.scores([t.encode().lower().split() for _, t in rows]), rtol=1e-5)


def test_many_blocks_give_what_one_gives(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, many = ({r.doc_id: r for r in suffix_tree_scores(docs, **more).collect()} for more in ({}, {"block_bytes": 3000}))
    assert len(one) == docs.count() and all(tuple(many[k])[:5] == tuple(r)[:5] and math.isclose(many[k].score, r.score, rel_tol=1e-9) and math.isclose(many[k].base_score, r.base_score, rel_tol=1e-9) for k, r in one.items())


def test_probabilities_of_a_state_add_up_to_one(spark, texts):
    """Over all 256 bytes, at any share: the next symbol after a text's start and after 't', 'th'."""
    for share in (0.0, 1e-3, 0.05):
        tree = train_suffix_tree(spark.createDataFrame([(t,) for t in texts], "text string"), 3, share, 0.0)
        for before in (b"\n", b"\nt", b"\nth", b"\nxx"):
            context = int.from_bytes(before[-3:], "big")
            grams = np.array([context << 8 | b for b in range(256)], np.uint64)
            every, counts = counted(np.concatenate([tree.grams, grams]), np.concatenate([tree.counts, np.zeros(256, np.int64)]))
            p = tree.probabilities(every, counts)[np.searchsorted(every, grams)]
            assert math.isclose(p.sum(), 1, rel_tol=1e-9)


def test_places():
    random.seed(2)
    keys = np.unique(np.array([random.getrandbits(random.choice([8, 20, 56])) for _ in range(5000)], np.uint64))
    asked = keys[np.array([random.randrange(len(keys)) for _ in range(20000)])]
    for tables in (1, 2, 5):
        assert (keys[Places(keys, tables).find(asked)] == asked).all()
