"""HTML to text, language identification and n-gram contamination beyond what the tables hold."""

import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from lodeframe.functions.html import BLOCK, HIDDEN, visible_text
from lodeframe.operators import contamination
from lodeframe.operators.contamination import contaminated_by_ngrams, ngram_hashes
from lodeframe.operators.languages import identify_languages

BY_HAND = [
    ("plain", "plain"),
    ("a<b>b</b>c", "abc"),
    ("<p>one<p>two</p>three", "one\ntwo\nthree"),
    ("x<br>y<br/>z", "x\ny\nz"),
    ("a <i> b </i> c\n d", "a b c d"),
    ("<script>var t='</p><b>';</script>shown", "shown"),
    ("<SCRIPT type='a>b'>x</ScRiPt >shown", "shown"),
    ("<script>no end <p>here", ""),
    ("<style>p{}</style><title>T</title>body", "body"),
    ("a<!-- <p> > --!>b<!-->c<!--->d", "abcd"),
    ("a<!-- open", "a"),
    ('<a title="a > b" href=x>link</a>', "link"),
    ("<a title='a \" > b'>link</a>", "link"),
    ("<a title=it's>x</a> it's <b>", "x it's"),
    ("1 < 2 && 3 > 2 <3", "1 < 2 && 3 > 2 <3"),
    ("&lt;b&gt; &amp;amp; &eacute;&#233;&#xE9; &copy", "<b> &amp; ééé ©"),
    ("a&nbsp;b", "a b"),
    ("<pre>  two\n    four\n</pre>  after  it", "  two\n    four\nafter it"),
    ("<textarea>a <b> &lt;\n c</textarea>", "a <b> <\n c"),
    ("<![CDATA[x]]>y<?php z ?>w</>v</ u>", "ywv"),
    ("cut <a href='x", "cut"),
    ("", ""),
    (None, None),
    ("<td>1<td>2<tr><td>3", "1\n2\n3"),
    ("<div><div><div></div></div></div>\n\n", ""),
]


@pytest.mark.parametrize(("page", "text"), BY_HAND)
def test_visible_text_by_hand(page, text):
    assert visible_text(page) == text


class Lines(HTMLParser):
    """The standard library's parser, for markup without ``pre``, ``textarea`` or odd ends."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.out = [], [""]

    def handle_starttag(self, tag, attrs):
        self.out += [""] * (tag in BLOCK)
        self.hidden += [tag] * (tag in HIDDEN)

    def handle_endtag(self, tag):
        self.out += [""] * (tag in BLOCK)
        if self.hidden and self.hidden[-1] == tag:
            self.hidden.pop()

    def handle_data(self, data):
        if not self.hidden:
            self.out[-1] += data

    def lines(self, page):
        self.feed(page)
        self.close()
        return "\n".join(x for x in (re.sub("[ \t\n\f\r]+", " ", y).strip(" ") for y in self.out) if x)


def test_visible_text_against_a_parser(spark):
    rng = random.Random(1)
    parts = ["<p>", "</p>", "<div class='a>b'>", "</div>", "<b>", "</b>", "<br>", "<!-- <p> -->", "&amp;", "&lt;i&gt;", "text ", " more\n", "<a href=\"x>y\" b = 'c'>", "</a>", "<style>p > a {}</style>", "<script>if (a < b) { t = '<p>'; }</script>", "<li>", "<td>", "é"]
    pages = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(500)]
    pages += [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    # pages are cut off at any place, which the parser takes for text
    whole = [p[: p.rfind(">") + 1] for p in pages]
    for page in whole:
        assert visible_text(page) == Lines().lines(page)


def test_visible_text_takes_linear_time():
    for page in ("<" * 200_000, "<a " * 100_000, "<a b='" * 50_000, "<!--" * 100_000, "<script>" * 50_000, "&" * 200_000, "<pre>" * 50_000 + "x\n" * 50_000, "<a =" + "= " * 100_000):
        visible_text(page)


def test_languages_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify_languages(docs, F.expr("doc_id % 4 = 1")).where("held_out").collect()
    assert len(got) == 250
    # of the texts of some length; the shortest have a single word
    assert sum(r["lang"] == r["predicted"] for r in got) >= 0.95 * len(got)


def test_languages_of_odd_rows(spark):
    schema = "doc_id long, text string, lang string, predicted int"
    rows = [(1, "the other thing is there", "en", 0), (2, "the then that this", "en", 0), (3, "les eaux sont belles", "fr", 0), (3, "les eaux sont belles", "fr", 0), (4, None, "fr", 0), (5, "", None, 0), (6, "ab", "en", 0), (None, "the thing", None, 0), (7, "les belles " * 500_000, None, 0)]
    got = identify_languages(spark.createDataFrame(rows, schema), F.lit(None).cast("boolean"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([(1, "en", False, "en"), (2, "en", False, "en"), (3, "fr", False, "fr"), (3, "fr", False, "fr"), (4, "fr", False, None), (5, None, False, None), (6, "en", False, None), (None, None, False, "en"), (7, None, False, "fr")], key=str)
    assert {r["predicted"] for r in identify_languages(spark.createDataFrame(rows, schema), F.lit(True)).collect()} == {None}
    assert identify_languages(spark.createDataFrame([], schema), F.lit(False)).count() == 0
    with pytest.raises(ValueError, match="256"):
        identify_languages(spark.createDataFrame([(i, "text", f"l{i}", 0) for i in range(257)], schema), F.lit(False))


@pytest.mark.parametrize("bits", [64, 1 << 26])
def test_contamination_by_definition(spark, monkeypatch, bits):
    # with one word of bits the map is full and every n-gram goes to the exact join
    monkeypatch.setattr(contamination, "BITS", bits)
    rng = random.Random(2)
    words = lambda k: [f"W{rng.randrange(30)}" for _ in range(k)]
    items = [words(rng.randrange(4, 20)) for _ in range(30)]
    docs = [words(rng.randrange(10)) + rng.choice(items)[: rng.randrange(5, 20)] + words(rng.randrange(10)) for _ in range(200)]
    rows = [(i, " ".join(w).lower() if i % 2 else "\n".join(w), 1) for i, w in enumerate(docs)] + [(None, " ".join(items[0]), 1), (5, " ".join(docs[5]), 1), (900, None, 1), (901, "", 1)]
    grams = lambda t: {tuple(x) for w in [(t or "").lower().split()] for x in (w[k : k + 8] for k in range(len(w) - 7))}
    known = set().union(*(grams(" ".join(w)) for w in items))
    want = sorted(((i, len(grams(t) & known)) for i, t, _ in rows if grams(t) & known), key=str)
    got = contaminated_by_ngrams(spark.createDataFrame(rows, "doc_id long, text string, shared int").repartition(3), spark.createDataFrame([(" ".join(w),) for w in items] + [(None,)], "text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert len(want) > 50


def test_contamination_without_rows(spark):
    docs, none = spark.createDataFrame([(1, "a b c d e f g h i")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert contaminated_by_ngrams(docs, none).count() == 0
    assert contaminated_by_ngrams(none, docs).count() == 0
    assert len(ngram_hashes([b"a"] * 10, 8)) == 3
