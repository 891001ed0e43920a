"""Token ids of whole texts, as a public tokenizer gives them, at the cost of distinct words.

``word_bpe`` vocabularies drop white space and never merge across it, so a text
may be cut at ASCII white space and each distinct word encoded once.  A word's
ASCII letters are lowered and a run of closing marks after a letter is split off
before the lookup; both leave the library's result unchanged.  A text that holds
``<|`` could hold a special string and goes to the library as it is.
"""

from __future__ import annotations

import json
import os
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from canopy.llm.common import SLICE_BYTES, byte_slices, text_pieces, utf8_parts

#: Closing marks that may be split off: no apostrophe, as contractions start with one.
CLOSING = string.punctuation.replace("'", "")
#: Letters that stay as they are under NFC and keep their length when lowered.
LETTERS = "a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017f"
#: Words kept by one worker; beyond it the memo starts anew, so memory stays bounded.
MEMO_WORDS = 300_000
BATCH_BYTES = 64_000


class Store:
    """Ids of numbered words, end to end in one array, found by word."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.bounds = np.zeros(1 << 14, np.int64)

    def add(self, words: list[str], lengths: np.ndarray, ids: np.ndarray) -> None:
        count = len(self.number)
        used = int(self.bounds[count])
        while used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while count + len(lengths) + 1 > len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        self.ids[used:used + len(ids)] = ids
        self.bounds[count + 1:count + 1 + len(lengths)] = used + np.cumsum(lengths)
        self.number.update(zip(words, range(count, count + len(words)), strict=True))

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids end to end) of the words with these numbers."""
        first = self.bounds[numbers]
        length = self.bounds[numbers + 1] - first
        before = np.cumsum(length) - length
        return length, self.ids[np.repeat(first - before, length) + np.arange(int(length.sum()))]


def spread(ids: np.ndarray, length: np.ndarray, index: np.ndarray
           ) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the indexed words end to end, their bounds); words lie end to end in ``ids``."""
    first = (np.cumsum(length) - length).astype(np.int32)
    size = length[index].astype(np.int32)
    ends = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
    source = np.repeat(first[index] - ends[:-1].astype(np.int32), size)
    source += np.arange(len(source), dtype=np.int32)
    return ids[source], ends


def _tails(words: pa.Array, bodies: pa.Array) -> pa.Array:
    """What follows each body in its word."""
    data, off = utf8_parts(words)
    size = np.diff(off) - np.diff(utf8_parts(bodies)[1])
    ends = np.concatenate(([0], np.cumsum(size)))
    source = np.repeat(off[1:] - ends[1:], size) + np.arange(int(ends[-1]))
    return pa.LargeStringArray.from_buffers(
        len(words), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[source].tobytes()))


class WordEncoder:
    """A memo of distinct words without their closing marks."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        # the same model for words of lower-case letters, which its normalizer and its
        # pre-tokenizer leave whole: they are only parted at spaces
        plain = json.loads(tokenizer_json) | {"normalizer": None, "added_tokens": []}
        suffix = plain["model"]["end_of_word_suffix"]
        plain["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [
            {"type": "WhitespaceSplit"},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True,
             "use_regex": False}]}
        self.plain = Tokenizer.from_str(json.dumps(plain))
        vocabulary = plain["model"]["vocab"]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.memo = Store()

    def _single(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of separate texts, in batches balanced by bytes."""
        lengths, ids = [], []
        for start, stop in byte_slices(pa.array(texts, pa.large_string()), SLICE_BYTES):
            for e in self.tokenizer.encode_batch(texts[start:stop], add_special_tokens=False):
                lengths.append(len(e))
                ids.append(np.asarray(e.ids, np.uint32))
        return np.asarray(lengths, np.int64), np.concatenate(ids or [np.zeros(0, np.uint32)])

    def _learn(self, new: pa.Array) -> None:
        """Words of letters only are joined by spaces, many to a call; a token with the end
        suffix closes each."""
        simple = pc.match_substring_regex(new, f"^[{LETTERS}]+$")
        letters = new.filter(simple)
        names = letters.to_pylist()
        cuts = list(byte_slices(letters, BATCH_BYTES))
        for group in range(0, len(cuts), 64):
            part = cuts[group:group + 64]
            for (start, stop), e in zip(part, self.plain.encode_batch_fast(
                    [" ".join(names[a:b]) for a, b in part], add_special_tokens=False),
                    strict=True):
                ids = np.asarray(e.ids, np.uint32)
                close = np.flatnonzero(self.ends[ids])
                assert len(close) == stop - start, "a word without an end token"
                self.memo.add(names[start:stop], np.diff(close, prepend=-1), ids)
        other = new.filter(pc.invert(simple)).to_pylist()
        if other:
            self.memo.add(other, *self._single(other))

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """Memo numbers of distinct words."""
        known, names = self.memo.number, words.to_pylist()
        number = np.fromiter((known.get(w, -1) for w in names), np.int64, len(names))
        new = np.flatnonzero(number < 0)
        if len(new):
            self._learn(words.take(pa.array(new)))
            number[new] = [known[names[i]] for i in new]
        return number

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids end to end) of distinct words, composed of body and closing marks."""
        if len(self.memo.number) > MEMO_WORDS:
            self.memo = Store()
        body = pc.utf8_rtrim(words, characters=CLOSING)
        cut = pc.match_substring_regex(body, f"[{LETTERS}]$")
        body = pc.if_else(cut, body, words)
        coded = body.dictionary_encode()
        tail = _tails(words, body).dictionary_encode()
        pair = np.empty(2 * len(words), np.int64)
        pair[0::2] = self._numbers(coded.dictionary)[np.asarray(coded.indices)]
        pair[1::2] = self._numbers(tail.dictionary)[np.asarray(tail.indices)]
        length, ids = self.memo.take(pair)
        return length[0::2] + length[1::2], ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, bounds by text) of a ``strings`` array of bounded size."""
        special = np.asarray(pc.match_substring(texts, "<|"))
        plain = pc.if_else(pa.array(special), pa.scalar("", pa.large_string()), texts) \
            if special.any() else texts
        lists = pc.ascii_split_whitespace(pc.ascii_lower(plain))
        coded = lists.flatten().dictionary_encode()
        length, ids = self._distinct(coded.dictionary)
        ids, ends = spread(ids, length, np.asarray(coded.indices))
        bounds = ends[np.asarray(lists.offsets, np.int64) - lists.offsets[0].as_py()]
        if special.any():
            parts = [ids[bounds[i]:bounds[i + 1]] for i in range(len(texts))]
            for i in np.flatnonzero(special):
                _, parts[i] = self._single([texts[int(i)].as_py()])
            ids = np.concatenate(parts)
            bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return ids, bounds

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Token counts only."""
        total = np.zeros(len(texts), np.int64)
        for pieces, rows in text_pieces(texts):
            _, bounds = self.encode(pieces)
            np.add.at(total, rows, np.diff(bounds))
        return total


_encoders: dict[int, WordEncoder] = {}


def encoder(tokenizer_json: str) -> WordEncoder:
    """One encoder for each worker process and vocabulary."""
    key = hash(tokenizer_json)
    if key not in _encoders:
        _encoders[key] = WordEncoder(tokenizer_json)
    return _encoders[key]


def utf8_lengths(texts: pa.Array) -> np.ndarray:
    return np.diff(utf8_parts(texts)[1])
