"""op6: base spans against the patterns by definition, estimates, masking."""

import hashlib
import random
import re

from lodeframe.llm.pii import _candidates, estimate, mask_pii, pii_spans, train_classifier

KINDS = ["email", "ip", "card", "phone"]
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        total = sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits))))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    return sorted((m.start(), k, m.end()) for k, kind in enumerate(KINDS) for m in re.finditer(PLAIN[kind], text or "") if passes(kind, m.group()))


def test_base_spans(spark, odd, none):
    random.seed(2)
    parts = list("aZ09..@@--  +()_%:é€\n\U0001f600") + ["192.168.1.1", "4539 1488 0343 6467", "+1 (614) 555-8001", "a.b@c.de", "000256.1.1.1", "123-45-6789", "4111111111111111", "1.2.3.4.5.6.7.8"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 30))) for _ in range(600)]
    texts += ["a" * 50_000, "a@b" + ".c" * 5_000, "1.2.3.4 x@y.zz " * 600, "+" + "(" * 20_000, "9" * 20_000, "5 " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts, 1000)), "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    known = {i: t for i, t in enumerate(texts, 1000)} | {r.doc_id: r.text for r in odd.collect()}
    got = pii_spans(df).collect()
    assert len(got) == df.count()
    for r in got:
        spans = brute(known[r.doc_id]) if not (known[r.doc_id] or "").startswith("5 5 ") else []
        joined = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s.split(":")[0] in KINDS] == [s for s in joined.split(",") if s]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in spans) for j in range(4)]
    assert pii_spans(none).count() == 0


def united(text, spans):
    """The text cut at its spans, by the definition."""
    out, end, label = [], 0, {k: f"<{k}>" for k in ("email", "ip", "card", "phone", "ssn", "account", "secret")}
    order = list(label)
    for kind, a, b in sorted(((k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)), key=lambda s: (s[1], order.index(s[0]))):
        if a >= end:
            out += [text[end:a], label[kind]]
        end = max(end, b)
    return "".join([*out, text[end:]])


def test_masked_texts_are_cut_at_the_spans(spark, monkeypatch):
    random.seed(3)
    parts = list("aZ09..@@--  +()_%:é€\n\U0001f600") + ["192.168.1.1", "4539 1488 0343 6467", "+1 (614) 555-8001", "a.b@c.de", "123-45-6789", "4111111111111111", "04dbebab91ab85687d33eeaaf9ac699e1188f962", "+1 10.0.0.1 555 1234"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 30))) for _ in range(400)]
    texts += ["call +1 10.0.0.1 555 1234 now", "", None, "\U0001f600" * 3000 + "a.b@c.de", "x" * 2047 + " 10.0.0.1 " + "y" * 5000, "1.2.3.4 x@y.zz " * 1500]
    rows = spark.createDataFrame([(i, t, t, [1]) for i, t in enumerate(texts)], "doc_id long, text string, spans string, ends array<int>")
    spans = {r.doc_id: r.spans for r in pii_spans(rows).collect()}
    got = mask_pii(rows)
    assert got.columns == rows.columns
    got = {r.doc_id: r for r in got.collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].text == (None if t is None else united(t, spans[i])), (t, spans[i])
        assert got[i].spans == t and got[i].ends == [1]
    assert got[400].text == "call <phone> now"


def test_secrets_are_found_and_words_are_not(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(k, f'token = "{key[:-2]}{k:02d}" set') for k in range(40)] + [(100, "x" * 30 + " plain")]
    got = {r.doc_id: r.spans for r in pii_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[3] == "secret:9:49" and got[100] == ""


def test_estimates_follow_reliable_labelers():
    random.seed(1)
    counts = {}
    for _ in range(4000):
        z = random.random() < 0.3
        votes = (int(z if random.random() < 0.95 else not z), int(z if random.random() < 0.9 else not z), random.randint(0, 1), -1)
        counts[(0, votes)] = counts.get((0, votes), 0) + 1
    p = estimate([(k, v, n) for (k, v), n in sorted(counts.items())])
    assert all(x > 0.5 for (_, v), x in p.items() if v[0] == v[1] == 1) and all(x < 0.5 for (_, v), x in p.items() if v[0] == v[1] == 0)
    assert estimate([]) == {}


def test_classifier_separates():
    kinds, features = train_classifier([(4, (True,), 0.9, 50), (4, (False,), 0.1, 50)])
    assert kinds[4] + features[0] > 0 > kinds[4]


def test_mask(spark, odd, none):
    out = mask_pii(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[9] == "mail <email> or call <phone> now, ip 10.0.0.256 and <ip>" and texts[3] is None and texts[2] == ""
    assert mask_pii(none).count() == 0


def planted(seed, n):
    """(text, kind, is it personal data) of further kinds, both told by their surroundings only."""
    random.seed(seed)
    filler = lambda: " ".join(random.choice("the of river walked under many seven doors again".split()) for _ in range(random.randint(3, 9)))
    digits = lambda k: str(random.randint(1, 9)) + "".join(random.choice("0123456789") for _ in range(k - 1))
    hexes = lambda: "".join(random.choice("0123456789abcdef") for _ in range(40))
    ssn = lambda: f"{random.randint(100, 665)}-{random.randint(10, 99)}-{random.randint(1000, 9999)}"
    forms = {
        "secret": ([lambda: f'token = "{hexes()}"', lambda: f"api key: {hexes()}", lambda: f"the password is {hexes()} for now"], [lambda: f"commit {hexes()} was merged", lambda: f"checksum/{hexes()} of it"]),
        "account": ([lambda: f"account: {digits(13)}", lambda: f"bank account {digits(12)} is my own"], [lambda: f"order {digits(13)} items", lambda: f"{digits(13)} people", lambda: digits(13)]),
        "ssn": ([lambda: f"ssn: {ssn()}", lambda: f"social security {ssn()}"], [lambda: f"part {ssn()} units", lambda: f"serial #{ssn()}"]),
    }
    for _ in range(n):
        kind = random.choice(list(forms))
        good = random.random() < 0.5
        yield f"{filler()} {random.choice(forms[kind][not good])()} {filler()}", kind, good


def test_precision_and_recall_on_planted_data(spark):
    rows = [(k, *x) for k, x in enumerate(planted(4, 900))]
    got = {r.doc_id: r.spans for r in pii_spans(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    for kind in ("secret", "account", "ssn"):
        said = {i for i, _, k, _ in rows if k == kind and f"{kind}:" in got[i]}
        true = {i for i, _, k, good in rows if k == kind and good}
        assert len(said & true) >= 0.95 * len(said) and len(said & true) >= 0.95 * len(true), kind


def test_each_labeler_says_yes_no_and_nothing(spark):
    texts = [t for t, _, _ in planted(4, 900)] + ['key "ghp0aB1cD2eF3gH4iJ5kL6mN7oP8q" expires', "token=aaaa1111aaaa1111aaaa1111aaaa units", "x/d41d8cd98f00b204e9800998ecf8427e bytes", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa12"]
    found = spark.createDataFrame([(t,) for t in texts], "text string")
    votes = [r.v for r in _candidates(found).selectExpr("explode(found) AS c").selectExpr("c.votes AS v").collect()]
    for j in range(6):
        assert {v[j] for v in votes} == {-1, 0, 1}, j


def test_a_long_secret(spark):
    key = "".join(random.choice("0123456789abcdef") for _ in range(4000))
    rows = [(k, f'token = "{k:04d}{key}" set') for k in range(20)]
    assert all(r.spans == "secret:9:4013" for r in pii_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_columns_with_clashing_names(odd):
    assert pii_spans(odd).count() == odd.count() and pii_spans(odd).columns[0] == "doc_id"
