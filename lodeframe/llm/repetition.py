"""Quality rules on repetition inside a text, by suffix arrays over words.

For a batch of texts one suffix array over word numbers is built by prefix doubling in numpy.
Each text has its own symbols, so suffixes of different texts never share a prefix.  In each
round only suffixes that still tie with another are ranked anew, so texts without repeats are
done after a round or two.  Two neighbours' longest common prefix comes from the ranks of the
rounds by binary lifting.

A suffix whose common prefix with a neighbour is at least ``window`` words starts a repeated
substring of that length; these are the longest-common-prefix intervals of that height and
above, so their spans' union is the union of the spans of all maximal repeats of at least
``window`` words, first occurrences included.

Rules: a text is kept if it has ``min_words`` words, at most ``max_percent`` % of its words lie in
repeats of ``window`` words or more (the base), and, the method's own verdict, at most
``max_char_percent`` % of its word characters lie there and its longest single repeat covers at
most ``max_longest_percent`` % of its words.

Cases: null text counts as empty, fails the rules and is not kept; a null id stays null;
repeated rows give repeated rows; an empty table gives no rows; other columns are ignored by
``repetition`` and returned untouched by ``keep_unrepetitive``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodeframe.llm.texts import as_bytes, id_and_text, sliced, sums_by

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_repeat_chars long, longest_repeat long"
SYMBOLS = b"#*$%&|<>"
#: Bytes of text per suffix array (a longer text has its own).
ARRAY_BYTES = 4 << 20


def common_prefixes(symbols: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that tie with another of the same text on their first symbol, in the order of
    the suffix array, and each one's longest common prefix with its predecessor (0: none)."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = int(symbols.max()) + 1
    keys = text_of.astype(np.int64) * size + symbols
    order = np.argsort(keys, kind="stable")
    rank = np.zeros(n + 1, np.int32)  # rank[n]: behind the end
    fresh = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
    rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1] + 1
    tied = _tied(fresh)
    levels, active, start = [rank.copy()], order[tied], rank[order[tied]]
    everything = active.copy()
    final = rank
    step = 1
    while len(active):
        beyond = active + step
        inside = beyond < n
        second = np.zeros(len(active), np.int64)
        second[inside] = np.where(text_of[beyond[inside]] == text_of[active[inside]], final[beyond[inside]], 0)
        again = np.argsort((start.astype(np.int64) << 32) | second, kind="stable")
        active, start, second = active[again], start[again], second[again]
        head = np.concatenate([[True], start[1:] != start[:-1]])
        fresh = head | np.concatenate([[True], second[1:] != second[:-1]])
        # a group that began at rank r keeps the ranks r, r + 1, ...
        place = np.arange(len(active)) - np.flatnonzero(head)[np.cumsum(head) - 1]
        new = start + place[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        final = final.copy()
        final[active] = new
        levels.append(final)
        still = _tied(fresh)
        active, start = active[still], final[active[still]]
        step *= 2
    everything = everything[np.argsort(final[everything], kind="stable")]
    left, right = everything[:-1].copy(), everything[1:].copy()
    lcp = np.zeros(len(left), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        ok = (left < n) & (right < n)
        same = np.zeros(len(left), bool)
        same[ok] = (level[left[ok]] == level[right[ok]]) & (text_of[left[ok]] == text_of[right[ok]])
        lcp[same] += 1 << k
        left[same] += 1 << k
        right[same] += 1 << k
    return everything, np.concatenate([[0], lcp]) if len(everything) else np.zeros(0, np.int64)


def _tied(fresh: np.ndarray) -> np.ndarray:
    """Which entries share their group with another; ``fresh``: a group begins here."""
    return ~(fresh & np.concatenate([fresh[1:], [True]]))


def repeats(symbols: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words lie in a substring of ``window`` words or more found twice in their text, and
    each text's longest repeat of at least that length."""
    n_texts = len(offsets) - 1
    text_of = np.repeat(np.arange(n_texts), np.diff(offsets))
    suffixes, lcp = common_prefixes(symbols, text_of)
    best = np.maximum(lcp, np.append(lcp[1:], 0)) if len(lcp) else lcp
    long = best >= window
    suffixes, best = suffixes[long], best[long]
    depth = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(depth, suffixes, 1)
    np.add.at(depth, suffixes + best, -1)
    longest = np.zeros(n_texts, np.int64)
    np.maximum.at(longest, text_of[suffixes], best)
    return np.cumsum(depth)[:-1] > 0, longest


def measures(texts: list[bytes], window: int = 8) -> dict[str, np.ndarray]:
    """The measures of each text."""
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    words = [t.split() for t in texts]
    symbols = [np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in words]
    n_words = np.fromiter(map(len, words), np.int64, len(words))
    offsets = np.concatenate([[0], np.cumsum(n_words)])
    symbols = np.concatenate(symbols) if symbols else np.zeros(0, np.int64)
    chars_of = np.fromiter((len(w.decode(errors="replace")) for w in numbers), np.int64, len(numbers))
    chars = chars_of[symbols] if len(symbols) else symbols
    inside, longest = repeats(symbols, offsets, window)
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    return {
        "n_words": n_words,
        "word_chars": sums_by(chars, offsets),
        "n_symbols": np.fromiter((len(t) - len(t.translate(None, SYMBOLS)) for t in texts), np.int64, len(texts)),
        "n_dup_lines": np.fromiter((len(x) - len(set(x)) for x in lines), np.int64, len(texts)),
        "n_repeat_words": sums_by(inside.astype(np.int64), offsets),
        "n_repeat_chars": sums_by(chars * inside, offsets),
        "longest_repeat": longest,
    }


def verdicts(m: dict[str, np.ndarray], min_words: int, max_percent: int, max_char_percent: int, max_longest_percent: int) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept."""
    failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > max_percent * m["n_words"])
    bad = (100 * m["n_repeat_chars"] > max_char_percent * m["word_chars"]) | (100 * m["longest_repeat"] > max_longest_percent * m["n_words"])
    return failed, ~failed & ~bad


def repetition(docs: DataFrame, window: int = 8, min_words: int = 20, max_percent: int = 30, max_char_percent: int = 30, max_longest_percent: int = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its measures and verdicts."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, limit=ARRAY_BYTES):
            m = measures(as_bytes(batch.column("text")), window)
            failed, kept = verdicts(m, min_words, max_percent, max_char_percent, max_longest_percent)
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(m[c]) for c in names), pa.array(failed), pa.array(kept), pa.array(m["n_repeat_chars"]), pa.array(m["longest_repeat"])],
                ["doc_id", *names, "base_failed", "kept", "n_repeat_chars", "longest_repeat"],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(measure, SCHEMA)


def keep_unrepetitive(docs: DataFrame, window: int = 8, min_words: int = 20, max_percent: int = 30, max_char_percent: int = 30, max_longest_percent: int = 25, text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, with all their columns."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col, ARRAY_BYTES):
            m = measures(as_bytes(batch.column(text_col)), window)
            yield batch.filter(pa.array(verdicts(m, min_words, max_percent, max_char_percent, max_longest_percent)[1]))

    return docs.mapInArrow(keep, docs.schema)
