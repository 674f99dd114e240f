"""Public tokenizer files by path, opened once per Python worker.

``.json`` files belong to the tokenizers library, ``.model`` files to sentencepiece.  A text is
cut into pre-tokens that the library encodes independently of each other, so a text's ids are
its pre-tokens' ids in a row:

* a tokenizer that collapses white space and keeps only the matches of a pattern that never
  match white space (word_bpe_49k) never joins characters across it: its pre-tokens are words;
* for any other file the whole text is the one pre-token.

Bytes that aren't UTF-8 count as the replacement character.
"""

from __future__ import annotations

import functools
import json
import os
import string
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct parts of texts whose ids a worker remembers; beyond it forgets all of them and goes on.
REMEMBERED = 1_200_000


@functools.cache
def _library(path: str):
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Fixed value: the pattern of word tokenizers whose white space only separates.  A run of letters
#: and the run of ASCII punctuation behind it are always matched apart.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PUNCTUATION = string.punctuation.encode()
#: Lead bytes of U+0300-U+036F; an ASCII letter composes with no other mark.
MARKS = (b"\xcc", b"\xcd")


@functools.cache
def drops_white_space(path: str) -> bool:
    """Whether white space only separates pre-tokens and case is ignored, going by the
    tokenizer's own file."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
    split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    wanted = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and split["pattern"].get("Regex") == WORD_PATTERN
    strings = [a["content"] for a in spec.get("added_tokens", []) if not a["lstrip"] and not a["rstrip"]]
    return bool(steps == ["NFC", "Replace", "Lowercase"] and wanted and len(strings) == len(spec.get("added_tokens", [])) and all(x.startswith("<|") and " " not in x for x in strings))


def pre_tokens(path: str):
    """A function from UTF-8 to its list of pre-tokens."""
    if drops_white_space(path):
        return bytes.split
    return lambda text: [text] if text else []


def _encodings(path: str, tokens: list[bytes]) -> list[list[int]]:
    texts = [t.decode(errors="replace") for t in tokens]
    if path.endswith(".model"):
        return _library(path).encode(texts, num_threads=1)
    return [e.ids for e in _library(path).encode_batch_fast(texts, add_special_tokens=False)]


@functools.cache
def _ends(path: str) -> np.ndarray | None:
    """Whether each id ends a pre-token of the library, where its vocabulary tells."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    suffix = model.get("end_of_word_suffix")
    if model["type"] != "BPE" or not suffix:
        return None
    ends = np.zeros(vocabulary_size(path), bool)
    ends[[i for piece, i in model["vocab"].items() if piece.endswith(suffix)]] = True
    return ends


#: Plain words that go to the library as one text.
JOINED = 2000


def encode(path: str, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the pre-tokens in a row and each one's number of ids, without added special
    tokens, truncation or padding.

    Words of letters only are one pre-token of the library each.  Where the last piece of a
    pre-token can be told by its id, many such words are encoded as one text, which costs the
    library less, and are told apart by those ids.
    """
    if not path.endswith(".model"):
        _library(path).no_truncation()
        _library(path).no_padding()
    counts = np.zeros(len(tokens), np.int64)
    ends = _ends(path) if drops_white_space(path) else None
    plain = [k for k, t in enumerate(tokens) if t.isalpha() or t.decode(errors="replace").isalpha()] if ends is not None else []
    parts: list[np.ndarray] = []
    order: list[np.ndarray] = []
    for a in range(0, len(plain), JOINED):
        own = np.array(plain[a : a + JOINED])
        ids = np.array(_encodings(path, [b" ".join([tokens[k] for k in own])])[0], np.uint32)
        last = np.flatnonzero(ends[ids])
        if len(last) != len(own):  # letters that the library sees otherwise
            plain = plain[:a]
            break
        counts[own] = np.diff(last, prepend=-1)
        parts.append(ids)
        order.append(own)
    done = set(plain)
    rest = [k for k in range(len(tokens)) if k not in done]
    for a in range(0, len(rest), 5000):
        own = rest[a : a + 5000]
        ids = _encodings(path, [tokens[k] for k in own])
        counts[own] = [len(x) for x in ids]
        parts.append(np.fromiter(chain.from_iterable(ids), np.uint32))
        order.append(np.array(own))
    if not parts:
        return np.zeros(0, np.uint32), counts
    sequence = np.concatenate(order)
    flat = np.concatenate(parts)
    starts = np.zeros(len(tokens), np.int64)
    starts[sequence] = np.cumsum(counts[sequence]) - counts[sequence]
    before = np.cumsum(counts) - counts
    return flat[np.repeat(starts - before, counts) + np.arange(int(counts.sum()))], counts


class Remembered:
    """Ids of the parts of texts that a worker met, found by number."""

    def __init__(self, path: str):
        self.path = path
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.flat, self.starts, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, distinct: list[bytes]) -> np.ndarray:
        """The numbers of ``distinct`` parts, after new ones were encoded."""
        if len(self.numbers) > REMEMBERED:
            self.forget()
        new = [x for x in distinct if x not in self.numbers]
        if new:
            ids, counts = encode(self.path, new)
            self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
            self.counts = np.concatenate([self.counts, counts])
            self.flat = np.concatenate([self.flat, ids])
        return np.fromiter(map(self.numbers.__getitem__, distinct), np.int64, len(distinct))


_IS_PUNCTUATION = np.isin(np.arange(256), np.frombuffer(PUNCTUATION, np.uint8))
_IS_LETTER = np.isin(np.arange(256), np.frombuffer(string.ascii_letters.encode(), np.uint8))
_TO_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def parts(path: str, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The parts of the texts in a row, which are encoded apart, and the place where each text's
    begin, closed by their number.

    Where white space only separates, a word's parts are its stem in lower case and the ASCII
    punctuation behind its last letter; the word as it is and nothing where that is not certain:
    special strings, and marks that may compose with what comes before.  Else a text is one part.
    """
    texts = texts.cast(pa.binary()).fill_null(b"")
    if not drops_white_space(path):
        return texts, np.arange(len(texts) + 1)
    words = pc.ascii_split_whitespace(texts.view(pa.string()))  # bytes need not be UTF-8
    flat = words.flatten()
    if not len(flat):
        return flat.cast(pa.binary()), np.zeros(len(texts) + 1, np.int64)
    _, offsets, data = flat.buffers()
    bounds = np.frombuffer(offsets, np.int32)[flat.offset : flat.offset + len(flat) + 1]
    # the words lie side by side, so stems and tails share their bytes
    held = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    firsts, ends = bounds[:-1], bounds[1:]
    last = np.where(_IS_PUNCTUATION[held], np.int32(0), np.arange(1, len(held) + 1, dtype=np.int32))
    last = np.concatenate([np.zeros(1, np.int32), np.maximum.accumulate(last)])[ends]
    cut = (last > firsts) & (last < ends)
    cut[cut] = _IS_LETTER[held[last[cut] - 1]]
    lowered = _TO_LOWER[held]
    odd = (held == MARKS[0][0]) | (held == MARKS[1][0])
    odd[:-1] |= (held[:-1] == ord("<")) & (held[1:] == ord("|"))
    for k in np.unique(np.searchsorted(ends, np.flatnonzero(odd), side="right")).tolist():
        cut[k] = False
        lowered[firsts[k] : ends[k]] = held[firsts[k] : ends[k]]
    both = np.empty(2 * len(flat) + 1, np.int32)
    both[0::2], both[1::2] = bounds, np.where(cut, last, ends)
    first = np.asarray(words.offsets).astype(np.int64)
    return pa.Array.from_buffers(pa.binary(), 2 * len(flat), [None, pa.py_buffer(both), pa.py_buffer(lowered)]), 2 * (first - first[0])


@functools.cache
def remembered(path: str) -> Remembered:
    return Remembered(path)


def vocabulary_size(path: str) -> int:
    library = _library(path)
    return library.get_piece_size() if path.endswith(".model") else library.get_vocab_size(with_added_tokens=True)
