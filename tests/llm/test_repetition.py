"""op4 against brute force."""

from hypothesis import given, settings
from hypothesis import strategies as st

from lodeframe.llm.repetition import keep_unrepetitive, measures, repetition


def brute(text, width=8):
    words = text.split()
    windows = {}
    for i in range(len(words) - width + 1):
        windows.setdefault(tuple(words[i : i + width]), []).append(i)
    covered = {k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + width)}
    longest = 0
    for n in range(width, len(words)):
        seen = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        if len(set(seen)) == len(seen):
            break
        longest = n
    lines = [x for x in text.split(b"\n") if x.split()]
    chars = [len(w.decode()) for w in words]
    return len(words), sum(chars), sum(text.count(c.encode()) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), sum(chars[k] for k in covered), longest


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_repeat_chars", "longest_repeat"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "é#", "|", "\n", "a\n"]), max_size=60).map(" ".join), max_size=6))
def test_measures(texts):
    texts = [t.encode() for t in texts]
    m = measures(texts)
    for k, t in enumerate(texts):
        assert tuple(int(m[n][k]) for n in NAMES) == brute(t)


def test_rows(odd, none):
    got = sorted(map(str, ((r.doc_id, *(r[n] for n in NAMES), r.base_failed) for r in repetition(odd).collect())))
    expected = []
    for r in odd.collect():
        m = brute((r.text or "").encode())
        expected.append(str((r.doc_id, *m, m[0] < 20 or 100 * m[4] > 30 * m[0])))
    assert got == sorted(expected)
    assert not any(r.kept and r.base_failed for r in repetition(odd).collect())
    assert repetition(none).count() == 0


def test_filter_keeps_columns(odd, none):
    kept = keep_unrepetitive(odd)
    assert kept.schema == odd.schema
    wanted = sorted(str(r.doc_id) for r in repetition(odd).collect() if r.kept)
    assert sorted(str(r.doc_id) for r in kept.collect()) == wanted
    assert keep_unrepetitive(none).count() == 0
