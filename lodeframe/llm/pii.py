"""Personal data by weak supervision, in DataFrame functions.

Candidates of every kind come from patterns.  Those of the base kinds (email, ip, card, phone) that
pass their tests are spans as they are; candidates of further kinds (ssn, account, secret) become
spans if the final classifier says so.

* Six labelers vote on every candidate: its form, lists of known values and prefixes, the words
  before it, the words after it, the signs around it, and its make-up.  Each says yes, no or
  nothing, and none repeats the test that made the candidate.
* Expectation-maximisation (Dawid and Skene, 1979) over the counts of vote patterns estimates, for
  each kind, how often a labeler says yes to what is and to what isn't personal data (towards
  common values where a kind has few candidates) and the kind's share of personal data, and so
  each pattern's probability.
* A logistic regression on the candidates' kind, surroundings and make-up, with those probabilities
  as soft labels, is the final span classifier.

What reaches the driver are counts by kind, votes and features: at most 7 * 3**6 * 2**6 rows,
whatever the corpus, and in practice some hundreds.  The candidates are written to the shared folder, so texts are read once.

Patterns are written so that Java matches them without recursion or rescanning (possessive
quantifiers; a run is entered at its start or where the last match ended).  Positions are running
sums over the pieces between matches, in code points.

Cases: null text counts as empty; a null id stays null; repeated rows give repeated rows; an
empty table gives no rows; other columns are ignored by ``pii_spans`` and returned untouched by
``mask_pii``.
"""

from __future__ import annotations

from functools import reduce
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.texts import id_and_text
from lodeframe.storage import stored

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "ssn", "account", "secret"]
#: Code points before and after a candidate that the labelers see.
CONTEXT = 64
CHUNK = 512

PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    "account": r"(?<![A-Za-z0-9.-])[0-9]{12,20}+(?![A-Za-z0-9.-])",
    "secret": r"(?<![A-Za-z0-9])[A-Za-z0-9]{24,}+(?![A-Za-z0-9])",
}

#: Gazetteers, what each kind's labelers look for (lower case).
LISTED = {
    "email": r"\.(?:com|org|net|edu|gov|io|de|fr|es|it|uk|eu|us|info|biz|dev|app|ai|co|ch|at|nl|pl|ca|au|jp)$",
    "ip": r"^(?:1[0-9]{0,2}|2[0-4][0-9]|[3-9][0-9]?|2[0-9]?)\.",
    "card": r"^(?:3[47]|4|5[1-5]|6011|65|2[2-7])",
    "phone": r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "account": r"^(?!.)",
    "secret": r"^(?:akia|asia|ghp|gho|glpat|xox[abps]|sk|pk|rk|aiza|eyj|npm|pypi)",
}
#: Values of documentation, tests and reserved ranges, which belong to nobody.
NOBODY = {
    "email": r"^(?:no-?reply|donotreply|postmaster|mailer-daemon|example|user|name|foo|bar)@|@(?:localhost|domain|test)\.",
    "ip": r"^(?:0|127|255|22[4-9]|23[0-9])\.",
    "card": r"^(?:4111111111111111|4242424242424242|5555555555554444|378282246310005|0)",
    "phone": r"^\+(?:0|1234567|999)",
    "ssn": r"^(?:123-45-6789|078-05-1120|219-09-9999|000|666|9)",
    "account": r"^(?:97[89][0-9]{10}$|(?:19|20)[0-9]{2}[01][0-9][0-3][0-9][0-2][0-9])",
    "secret": r"^(?:d41d8cd98f00b204e9800998ecf8427e|da39a3ee5e6b4b0d3255bfef95601890afd80709)$",
}
CUES = {
    "email": "mail e-mail email contact write reach",
    "ip": "ip host server address login client",
    "card": "card visa credit debit payment mastercard",
    "phone": "phone tel call fax mobile cell",
    "ssn": "ssn social security",
    "account": "account acct iban bank customer passport beneficiary",
    "secret": "token key secret password passwd api auth bearer credential",
}
AGAINST = {
    "email": "version",
    "ip": "version release section figure",
    "card": "isbn order serial part item",
    "phone": "isbn version",
    "ssn": "part item serial order isbn model",
    "account": "order isbn serial part item timestamp population version page",
    "secret": "commit checksum digest md5 sha1 sha256 revision build hash etag",
}
AFTER = {"yes": "expires|exp|valid|belongs|is my", "no": "units|items|pages|people|bytes|times|years|km|kg|usd|eur"}


def _running(values: Column, merge=lambda a, x: a + x) -> Column:
    """Running sums (or what ``merge`` makes), that before each value, from 0; in chunks, as an array grows by copying."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")), lambda c: F.slice(values, c * CHUNK + 1, F.lit(CHUNK)))

    def sums(items: Column, start: Column) -> Column:
        return F.slice(F.aggregate(items, F.array(start), lambda done, x: F.concat(done, F.array(merge(F.element_at(done, -1), x)))), F.lit(1), F.size(items))

    zero = F.lit(0).cast("long")
    totals = F.transform(chunks, lambda c: F.aggregate(c, zero, merge))
    return F.flatten(F.zip_with(chunks, sums(totals, zero), sums))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    digits = F.reverse(_digits(m))

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    """The test that a base candidate must pass; further kinds leave out what is one already."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(_digits(m)).between(14, 19), _luhn(m)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    if kind == "account":
        return F.when(F.length(m).between(14, 19), ~_luhn(m)).otherwise(True)
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, 0).otherwise(-1)


def _words(words: str) -> str:
    return rf"\b(?:{'|'.join(words.split())})s?\b"


def _variety(m: Column) -> Column:
    """The number of distinct letters and digits."""
    return F.size(F.array_distinct(F.split(F.regexp_replace(F.lower(m), "[^a-z0-9]", ""), "")))


def _votes(kind: str, m: Column, before: Column, after: Column) -> list[Column]:
    """What each labeler says: 1 yes, 0 no, -1 nothing."""
    form = {  # usual spellings, and spellings that something else has
        "email": (r"^[A-Za-z][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$", r"^[._%+-]|@[0-9.]+$"),
        "ip": (r"^[1-9][0-9]{1,2}\.[0-9]{2,3}\.", r"(?:^|\.)0[0-9]|^(?:[0-9]\.){3}[0-9]$"),
        "card": (r"^(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}|[0-9]{15,16})$", r"[ -][0-9][ -]|[ -][0-9]$"),
        "phone": (r"^\+[0-9]{1,3}[ (.-]*[0-9]{2,4}[) .-]+[0-9]", r"[.-]{2}|\([^)]*$"),
        "ssn": (r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$", r"^0"),
        "account": (r"^(?!.)", r"^0|0000$"),
        "secret": (r"^(?:[0-9a-f]+|[0-9A-F]+|(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9]).+)$", r"^[A-Za-z]+[0-9]{1,4}$|^[0-9]{16,}[A-Za-z]+$"),
    }[kind]
    low, near = F.lower(m), F.lower(before)
    varied = _variety(m)
    digits = kind in ("ip", "card", "phone", "ssn", "account")
    cue, against = near.rlike(_words(CUES[kind])), near.rlike(_words(AGAINST[kind]))
    return [
        _vote(m.rlike(form[0]) & ~m.rlike(form[1]), m.rlike(form[1])),
        _vote(low.rlike(LISTED[kind]) & ~low.rlike(NOBODY[kind]), low.rlike(NOBODY[kind])),
        _vote(cue & ~against, against),
        _vote(F.lower(after).rlike(rf"^[\s,;.]*(?:{AFTER['yes']})\b"), F.lower(after).rlike(rf"^[\s,;.]*(?:{AFTER['no']})\b")),
        _vote(before.rlike(r"[=:\"'(<\[]\s*$"), before.rlike(r"[\p{L}\p{N}_/#-]$") | after.rlike(r"^[\p{L}\p{N}_/-]")),
        _vote(varied >= (5 if digits else 9), varied <= (2 if digits else 5)),
    ]


def _features(kind: str, m: Column, before: Column, after: Column) -> list[Column]:
    """Yes or no on a candidate's surroundings and make-up, for the final classifier."""
    near = F.lower(before)
    return [near.rlike(_words(CUES[kind])), near.rlike(_words(AGAINST[kind])), before.rlike(r"[=:\"'(<\[]\s*$"), _variety(m) >= 9, F.length(m) >= 32, before.rlike(r"[\p{L}\p{N}_/#-]$")]


def _cut(kind: str, text: Column) -> Column:
    """A text's matches of a kind and the pieces around them (one piece more)."""
    pattern = PATTERNS[kind]
    return F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _matches(held: Column) -> Column:
    """Each match with its start and the pieces before and after it."""
    n = F.size(held["matches"])
    lengths = F.zip_with(held["pieces"], held["matches"], lambda p, m: (F.length(p) + F.coalesce(F.length(m), F.lit(0))).cast("long"))
    starts = F.zip_with(_running(lengths), held["pieces"], lambda s, p: s + F.length(p))
    around = F.zip_with(F.slice(held["pieces"], F.lit(1), n), F.slice(held["pieces"], F.lit(2), n), lambda p, q: F.struct(F.right(p, F.lit(CONTEXT)).alias("before"), F.left(q, F.lit(CONTEXT)).alias("after")))
    placed = F.zip_with(held["matches"], F.slice(starts, F.lit(1), n), lambda m, s: F.struct(m.alias("m"), s.alias("start")))
    return F.zip_with(placed, around, lambda a, b: F.struct(a["m"].alias("m"), a["start"].alias("start"), b["before"].alias("before"), b["after"].alias("after")))


def _candidate(kind: str, r: Column) -> Column:
    return F.struct(
        r["start"].cast("long").alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (r["start"] + F.length(r["m"])).cast("long").alias("end"),
        F.array(*_votes(kind, r["m"], r["before"], r["after"])).alias("votes"), F.array(*_features(kind, r["m"], r["before"], r["after"])).alias("features"),
    )


def _found(kind: str, text: Column) -> Column:
    """All candidates of a kind that pass its test."""

    def located(held: Column) -> Column:
        return F.transform(F.filter(_matches(held), lambda r: _passes(kind, r["m"])), lambda r: _candidate(kind, r))

    return F.when(text.rlike(PATTERNS[kind]), _let(_cut(kind, text), located))


def _clip(p: float) -> float:
    return min(1 - 1e-6, max(1e-6, p))


#: How often a labeler that speaks says yes to what is and to what isn't personal data, before any
#: candidate was seen, and as how many candidates of a kind that counts.
PRIOR, WEIGHT = {1: 0.8, 0: 0.2}, 4.0


def estimate(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 50) -> dict[tuple[int, tuple[int, ...]], float]:
    """The probability of personal data for each (kind, votes), from (kind, votes, count)."""
    kinds = sorted({k for k, _, _ in patterns})
    labelers = range(len(patterns[0][1])) if patterns else range(0)
    says = {(k, j, z): PRIOR[z] for k in kinds for j in labelers for z in (0, 1)}
    share = dict.fromkeys(kinds, 0.3)
    out: dict[tuple[int, tuple[int, ...]], float] = {}
    for _ in range(rounds):
        for k, votes, _ in patterns:
            odds = log(share[k] / (1 - share[k]))
            for j, v in enumerate(votes):
                if v >= 0:
                    one, none = (says[k, j, z] if v else 1 - says[k, j, z] for z in (1, 0))
                    odds += log(one / none)
            out[k, votes] = 1 / (1 + exp(-max(-40.0, min(40.0, odds))))
        for k in kinds:
            own = [(n, votes, out[k, votes]) for i, votes, n in patterns if i == k]
            for j in labelers:
                for z in (0, 1):
                    spoken = [(n * (p if z else 1 - p), votes[j]) for n, votes, p in own if votes[j] >= 0]
                    says[k, j, z] = _clip((sum(w for w, v in spoken if v) + WEIGHT * PRIOR[z]) / (sum(w for w, _ in spoken) + WEIGHT))
            share[k] = _clip((sum(n * p for n, _, p in own) + 0.3 * WEIGHT) / (sum(n for n, _, _ in own) + WEIGHT))
    return out


def train_classifier(rows: list[tuple[int, tuple[bool, ...], float, int]], rounds: int = 500, rate: float = 0.5, penalty: float = 1e-3) -> tuple[list[float], list[float]]:
    """Weights of the kinds and of the features, from (kind, features, probability, count)."""
    kinds, features = [0.0] * len(KINDS), [0.0] * (len(rows[0][1]) if rows else 0)
    total = sum(n for *_, n in rows) or 1
    for _ in range(rounds):
        by_kind, by_feature = [penalty * w for w in kinds], [penalty * w for w in features]
        for k, own, p, n in rows:
            z = kinds[k] + sum(w for w, f in zip(features, own, strict=True) if f)
            error = n * (1 / (1 + exp(-max(-40.0, min(40.0, z)))) - p) / total
            by_kind[k] += error
            for i, f in enumerate(own):
                by_feature[i] += error * f
        kinds = [w - rate * len(KINDS) * g for w, g in zip(kinds, by_kind, strict=True)]
        features = [w - rate * g for w, g in zip(features, by_feature, strict=True)]
    return kinds, features


#: No candidate.
NONE = "array<struct<start:bigint,kind:int,end:bigint,votes:array<int>,features:array<boolean>>>"


def _all_found(text: Column) -> Column:
    """The candidates of all kinds in a text."""
    return F.concat(*(F.coalesce(_found(kind, text), F.array().cast(NONE)) for kind in KINDS))


def _candidates(rows: DataFrame) -> DataFrame:
    """``rows`` with all candidates of a text (column ``text``) as ``found``."""
    text = F.col("text")
    # explode() of one value keeps the optimizer from repeating it in later terms
    return rows.where(text.rlike("[0-9@]")).select("*", F.explode(F.array(_all_found(text))).alias("found"))


def _classified(found: DataFrame) -> Column:
    """The condition on a candidate ``c`` to be a span, learned from all of ``found``."""
    each = found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes", "c.features").agg(F.count("*").alias("n")).collect()
    by_votes: dict[tuple[int, tuple[int, ...]], int] = {}
    for r in each:
        key = (r["kind"], tuple(r["votes"]))
        by_votes[key] = by_votes.get(key, 0) + r["n"]
    p = estimate(sorted((k, v, n) for (k, v), n in by_votes.items()))
    rows = sorted((r["kind"], tuple(r["features"]), p[r["kind"], tuple(r["votes"])], r["n"]) for r in each)
    kinds, features = train_classifier(rows)

    def condition(c: Column) -> Column:
        weight = F.element_at(F.array(*map(F.lit, kinds)), c["kind"] + 1)
        score = reduce(lambda a, i: a + F.when(F.get(c["features"], F.lit(i)), features[i]).otherwise(0.0), range(len(features)), weight)
        return (c["kind"] < len(BASE)) | (score > 0)

    return condition


def _is(kind: int):
    return lambda c: c["kind"] == kind


def _text_of(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.element_at(name, c["kind"] + 1), c["start"], c["end"])), ",")


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, the digest of the base spans, all spans."""
    rows = id_and_text(docs, id_col, text_col)
    none = F.array().cast(NONE)
    with_any = stored(_candidates(rows).select("doc_id", "found"), "candidates")
    condition = _classified(with_any)
    plain = rows.where(~F.col("text").rlike("[0-9@]")).select("doc_id", none.alias("found"))
    every = with_any.unionByName(plain)
    spans = every.select("doc_id", F.explode(F.array(F.array_sort(F.filter("found", condition)))).alias("spans"))
    base = F.filter("spans", lambda c: c["kind"] < len(BASE))
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(BASE)]
    return spans.select("doc_id", *counts, F.sha2(_text_of(base), 256).alias("base_sha256"), _text_of(F.col("spans")).alias("spans"))


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with the spans of their texts, as ``pii_spans`` finds them, replaced by their kinds in angle
    brackets.  Spans that overlap are one, named after the first of them (of those that start together: the
    kind listed first).  Texts without spans (and nulls) stay as they are."""
    condition = _classified(stored(_candidates(docs.select(F.col(text_col).alias("text"))).select("found"), "candidates"))
    text = F.col(f"held.{text_col}")
    held = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("held"))
    found = F.when(text.rlike("[0-9@]"), F.array_sort(F.filter(_all_found(text), condition)))
    spans = held.select("held", F.explode(F.array(found)).alias("spans"))
    ends = spans.select("held", "spans", F.explode(F.array(_running(F.transform("spans", lambda c: c["end"]), lambda a, x: F.greatest(a, x)))).alias("ends"))
    masked = F.when(F.size("spans") > 0, _let(_chunks(text), _masked)).otherwise(text)
    return ends.select(*(masked.alias(c) if c == text_col else F.col("held")[c].alias(c) for c in docs.columns))


#: Code points of the chunks in which a text is cut at spans, so that no cut counts from the text's start.
CUT = 2048


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CUT}}}"), F.lit(0))


def _masked(chunks: Column) -> Column:
    """A text put together from its chunks, with united spans replaced; ``ends``: the last end before each span."""

    def piece(start: Column, end: Column) -> Column:
        first = F.floor(start / CUT).cast("int")
        n = F.when(end > start, F.floor((end - 1) / CUT).cast("int") - first + 1).otherwise(0)
        return F.substr(F.array_join(F.slice(chunks, first + 1, n), ""), (start % CUT + 1).cast("int"), (end - start).cast("int"))

    begin = F.filter(F.zip_with("spans", "ends", lambda c, e: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), e.alias("before"))), lambda c: c["start"] >= c["before"])
    name = F.array(*(F.lit(f"<{kind}>") for kind in KINDS))
    parts = F.transform(begin, lambda c: F.concat(piece(c["before"], c["start"]), F.element_at(name, c["kind"] + 1)))
    last = F.array_max(F.transform("spans", lambda c: c["end"]))
    length = (F.size(chunks) - 1) * CUT + F.length(F.element_at(chunks, -1))
    return F.concat(F.array_join(parts, ""), piece(last, length))
