"""op8 against greedy string tiling by definition."""

import random

from lodeframe.llm import tiling
from lodeframe.llm.tiling import Index, contaminated, drop_contaminated


def brute(text, item, shortest):
    in_text, in_item, total = [False] * len(text), [False] * len(item), 0
    while True:
        best, at = shortest - 1, None
        for q in range(len(item)):
            for p in range(len(text)):
                k = 0
                while q + k < len(item) and p + k < len(text) and item[q + k] == text[p + k] and not in_item[q + k] and not in_text[p + k]:
                    k += 1
                if k > best:
                    best, at = k, (p, q)
        if at is None:
            return total
        for k in range(best):
            in_text[at[0] + k] = in_item[at[1] + k] = True
        total += best


def test_tiles():
    random.seed(3)
    for _ in range(250):
        letters = "abcdefgh"[: random.choice([1, 2, 3, 8])]
        item = [random.choice(letters) for _ in range(random.randint(3, 25))]
        text = [random.choice(letters) for _ in range(random.randint(0, 60))]
        if random.random() < 0.5:
            k = random.randint(0, len(item))
            text += [*item[k:], "z", *item[:k]]
        got = list(Index([(1, " ".join(item))], 3, 0.0001).matches([" ".join(text).encode()]))
        assert (got[0][3] if got else 0) == brute(text, item, 3)


PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def test_whole_edited_and_reordered_passages(spark):
    w = PASSAGE.split()
    edited = " ".join(w[:9] + ["CHANGED"] + w[10:])
    turned = " ".join(w[10:] + ["and", "then"] + w[:10])
    docs = [(1, f"before {PASSAGE.upper()}! after"), (2, edited), (3, turned), (4, " ".join(w[:6])), (5, "nothing of it"), (6, None), (None, PASSAGE)]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in docs], "doc_id long, text string, coverage double")
    bench = spark.createDataFrame([(7, PASSAGE), (8, "too short"), (9, None), (None, "x")], "item_id long, text string")
    for block_bytes in (1 << 20, 64):  # one block, several
        assert {(r.doc_id, r.item_id) for r in contaminated(df, bench, block_bytes=block_bytes).collect()} == {(1, 7), (2, 7), (3, 7), (None, 7)}
        kept = drop_contaminated(df, bench, block_bytes=block_bytes)
        assert kept.schema == df.schema and {r.doc_id for r in kept.collect()} == {4, 5, 6}


def test_empty_tables(spark, odd, none):
    bench = spark.createDataFrame([(7, PASSAGE)], "item_id long, text string")
    assert contaminated(none, bench).count() == 0 and contaminated(odd, bench.limit(0)).count() == 0
    assert drop_contaminated(odd, bench.limit(0)).count() == odd.count()


def test_common_seeds_lose_no_match(monkeypatch):
    """Nearly every seed is common here, so most are looked up only where an item needs them."""
    monkeypatch.setattr(tiling, "HOT", 1)
    random.seed(11)
    phrase = [f"p{k}" for k in range(12)]
    for _ in range(40):
        items = []
        for i in range(6):
            own = [f"w{random.randrange(40)}" for _ in range(random.randint(0, 20))]
            k = random.randint(0, len(own))
            items.append((i, own[:k] + phrase[: random.randint(3, 12)] + own[k:]))
        texts = []
        for _ in range(6):
            words = [w for i in random.choices(range(6), k=2) for w in items[i][1][random.randint(0, 6) :]]
            texts.append(words if random.random() < 0.5 else phrase + words[:4])
        for coverage in (0.3, 0.6, 1.0):
            index = Index([(i, " ".join(w)) for i, w in items], 3, coverage)
            got = {(t, i): n for t, i, _, n, _ in index.matches([" ".join(w).encode() for w in texts])}
            sums = {(t, i): brute(text, item, 3) for t, text in enumerate(texts) for i, item in items}
            assert got == {key: n for key, n in sums.items() if n >= coverage * len(items[key[1]][1]) and n}


def test_bytes_that_are_not_utf8():
    assert [m[0] for m in Index([(1, PASSAGE)], 5, 0.6).matches([b"\xff\xfe", b"\xff " + PASSAGE.encode()])] == [1]
