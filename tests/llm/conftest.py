import pytest

TEXTS = [
    (1, "The cat sat on the mat. " * 8),
    (2, ""),
    (3, None),
    (4, "one two three four five six seven eight nine ten " * 3),
    (None, "no id here, but words enough to count for something at least"),
    (5, "same text\nsame text\n\nother"),
    (5, "same text\nsame text\n\nother"),
    (6, "x"),
    (7, "Grüße aus Köln, 中文 и кириллица \U0001f600 ééé"),
    (8, "word " * 3000),
    (9, "mail a.b@c.de or call +1 (614) 555-8001 now, ip 10.0.0.256 and 10.0.0.25"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with results."""
    rows = [(i, t, 1, "k", 2.5, True, None) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words long, kind string, score double, kept boolean, found string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
