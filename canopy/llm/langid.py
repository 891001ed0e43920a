"""Language ID (1): spans of languages in mixed text.

Training counts letter trigrams (with word edges) per language, in a fixed number
of hash buckets, on a bounded sample: ``per_language`` labelled documents of each
language, chosen by the hash of their id.  A language's scripts are those that hold
at least ``SCRIPT_SHARE`` of its letters.

Labelling scores every word of a text under every language: the word's script
narrows the candidates strictly (where it is the script of any learned language), then its
trigrams' log probabilities add up.  Viterbi over
the words, with a penalty for each switch, labels the spans.  The chain runs in
blocks of 64 words for all texts of a slice at once: block matrices first (best
score from each entry to each exit language), then one pass over the blocks of each
text, then the words inside each block.  Texts over ``SLICE_BYTES`` are read in pieces cut
at white space and labelled by one chain over the words of all pieces, so a cut changes no
result.

A text's language is that of its opening and closing spans where they agree and hold at
least ``HOST_SHARE`` of the letters (passages in other languages are then quoted inside
it), else the language with most letters.

Defined cases: text that is null or has no letter gives 'und', score 0, no spans;
with nothing learned every text is 'und'; ties go to the language that sorts first;
a null doc_id is kept (and never learned from); repeated rows give repeated results;
further columns are ignored.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import (
    SLICE_BYTES,
    hash_share,
    release_memory,
    strings,
    text_pieces,
    utf8_parts,
)

BUCKETS = 1 << 16
PER_LANGUAGE = 20_000
SCRIPT_SHARE = 0.005
SWITCH_PENALTY = 8.0
HOST_SHARE = 0.2
WORD_RANGE = 12.0
EXCLUDED = 1e4
#: Scripts that write no spaces: a whole clause is one run of letters there, so the range of
#: its score grows with its length, by WORD_RANGE for each so many letters.
UNSPACED, UNSPACED_WORD = ("han", "kana", "thai", "lao", "khmer"), 4
BLOCK = 64

# First and last code point of the scripts that narrow the candidates.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF),
    ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F),
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F),
    ("gujarati", 0x0A80, 0x0AFF), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("sinhala", 0x0D80, 0x0DFF),
    ("thai", 0x0E00, 0x0E7F), ("lao", 0x0E80, 0x0EFF), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x137F), ("khmer", 0x1780, 0x17FF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x2FA1F),
)
SCRIPT_NAMES = sorted({name for name, _, _ in SCRIPTS})


@cache
def _letters() -> np.ndarray:
    """For each code point: 0 no letter, 1 a mark inside words, 2 a letter of no listed
    script, 3 + k a letter of script k."""
    kind = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            kind[c] = 2
        elif c > 0x2FF and c < 0x20000 and unicodedata.category(s)[0] == "M":
            kind[c] = 1
    for name, lo, hi in SCRIPTS:
        part = kind[lo:hi + 1]
        part[part == 2] = 3 + SCRIPT_NAMES.index(name)
    return kind


def _codepoints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of the lowered texts, offsets by text)."""
    data, off = utf8_parts(pc.utf8_lower(texts))
    first = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, first[off]


class _Letters:
    """Letters of a slice: buckets, kinds and word bounds (words never span texts)."""

    def __init__(self, texts: pa.Array):
        points, off = _codepoints(texts)
        kind = _letters()[points]
        inside = kind > 0
        z = np.zeros(len(points) + 2, np.uint32)
        z[1:-1] = np.where(inside, points, 0)
        self.at = np.flatnonzero(inside)
        left, right = z[self.at], z[self.at + 2]
        edge = np.zeros(len(points) + 1, bool)  # text starts
        edge[off[:-1]] = True
        left = np.where(edge[self.at], 0, left)
        right = np.where(edge[self.at + 1], 0, right)
        mixed = left * np.uint32(0x9E3779B1) + z[self.at + 1] * np.uint32(0x85EBCA77) \
            + right * np.uint32(0xC2B2AE3D)
        mixed ^= mixed >> np.uint32(15)
        self.bucket = (mixed * np.uint32(0x27D4EB2F)) >> np.uint32(16)
        self.kind = kind[self.at]
        self.word = np.flatnonzero(left == 0)  # first letter of each word, by letter number
        self.length = np.diff(np.append(self.word, len(self.at)))
        self.row = np.searchsorted(off, self.at[self.word], side="right") - 1
        self.off = off


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages, log probabilities
    allowed: np.ndarray  # kinds x languages


def train(docs: DataFrame, where: Column, lang_col: str = "lang",
          per_language: int = PER_LANGUAGE) -> Model:
    """Learn from the rows for which ``where`` holds; text and language must be present."""
    base = docs.filter(where & F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in base.groupBy(F.col(lang_col)).count().collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((64, 0), bool))
    languages = sorted(sizes)
    number = {x: k for k, x in enumerate(languages)}
    chosen = F.lit(False)
    for lang, n in sizes.items():
        chosen = chosen | ((F.col(lang_col) == lang)
                           & hash_share(F.col("doc_id"), min(1.0, per_language / n)))
    sample = base.filter(chosen & F.col("text").isNotNull()).select(
        "text", F.col(lang_col).alias("lang"))
    width = BUCKETS + 64

    def count(batches):
        total = np.zeros(len(languages) * width, np.int64)
        for batch in batches:
            lang = np.asarray([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            for pieces, rows in text_pieces(strings(batch.column("text"))):
                x = _Letters(pieces)
                if not len(x.at):
                    continue
                own = np.repeat(lang[rows[x.row]], x.length) * width
                total += np.bincount(own + x.bucket, minlength=len(total))
                total += np.bincount(own + BUCKETS + x.kind, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    counts = sample.mapInArrow(count, "cell long, n long").groupBy("cell").agg(
        F.sum("n").alias("n"))
    cells = np.zeros(len(languages) * width)  # at most languages x width rows come back
    got = counts.toArrow()
    cells[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    cells = cells.reshape(len(languages), width)
    trigrams, kinds = cells[:, :BUCKETS], cells[:, BUCKETS:]
    log = np.log((trigrams + 0.5) / (trigrams.sum(1, keepdims=True) + 0.5 * BUCKETS))
    share = kinds / np.maximum(kinds.sum(1, keepdims=True), 1)
    return Model(languages, np.ascontiguousarray(log.T, np.float32), (share >= SCRIPT_SHARE).T)


def _word_scores(x: _Letters, model: Model) -> np.ndarray:
    """Score of each word under each language, 0 for the best and down to -WORD_RANGE, or
    -EXCLUDED where the word's script is another language's and not this one's."""
    scores = np.add.reduceat(model.weights[x.bucket], x.word, axis=0)
    allowed = model.allowed[x.kind[x.word]]
    none = ~allowed.any(1)
    scores = np.where(allowed | none[:, None], scores, -np.inf)
    scores -= scores.max(1, keepdims=True)
    unspaced = np.isin(x.kind[x.word], [3 + SCRIPT_NAMES.index(s) for s in UNSPACED])
    least = -WORD_RANGE * np.where(unspaced, np.maximum(1, x.length / UNSPACED_WORD), 1)
    scores = np.where(np.isneginf(scores), -EXCLUDED,
                      np.maximum(scores, least[:, None])).astype(np.float32)
    scores[none] = 0
    return scores


def viterbi(scores: np.ndarray, bounds: np.ndarray, penalty: float = SWITCH_PENALTY
            ) -> np.ndarray:
    """Best label of each word; text k holds words bounds[k]:bounds[k + 1]."""
    n_lang = scores.shape[1]
    words = np.diff(bounds)
    blocks = -(-words // BLOCK)
    first_block = np.concatenate(([0], np.cumsum(blocks)))
    n_blocks = int(first_block[-1])
    if not n_blocks:
        return np.zeros(0, np.int64)
    text_of = np.repeat(np.arange(len(words)), blocks)
    start = bounds[text_of] + (np.arange(n_blocks) - first_block[text_of]) * BLOCK
    size = np.minimum(BLOCK, bounds[text_of + 1] - start)
    padded = np.zeros((BLOCK, n_blocks, n_lang), np.float32)
    for t in range(BLOCK):
        has = size > t
        padded[t, has] = scores[start[has] + t]
    # best score from each entry label to each exit label
    step = np.float32(penalty)
    stay = np.where(np.eye(n_lang, dtype=bool), 0, -step).astype(np.float32)
    matrix = np.broadcast_to(stay, (n_blocks, n_lang, n_lang)) + padded[0][:, None, :]
    for t in range(1, BLOCK):
        matrix = np.maximum(matrix, matrix.max(2, keepdims=True) - step) + padded[t][:, None, :]
    # over the blocks of each text, longest texts first
    order = np.argsort(-blocks, kind="stable")
    value = np.zeros((len(words), n_lang), np.float32)
    entry = np.zeros((n_blocks, n_lang), np.int16)
    for k in range(int(blocks.max())):
        live = order[:int(np.searchsorted(-blocks[order], -k, side="left"))]
        b = first_block[live] + k
        through = value[live][:, :, None] + matrix[b]
        entry[b] = through.argmax(1)
        value[live] = through.max(1)
        value[live] -= value[live].max(1, keepdims=True)
    leave = np.zeros(n_blocks, np.int64)
    come = np.zeros(n_blocks, np.int64)
    state = value.argmax(1)
    for k in range(int(blocks.max()) - 1, -1, -1):
        live = np.flatnonzero(blocks > k)
        b = first_block[live] + k
        leave[b] = state[live]
        state[live] = come[b] = entry[b, state[live]]
    # words inside each block, from its entry label
    rows = np.arange(n_blocks)
    score = stay[come] + padded[0]
    back = np.zeros((BLOCK, n_blocks, n_lang), np.int16)
    labels = np.arange(n_lang, dtype=np.int16)
    for t in range(1, BLOCK):
        best = score.argmax(1)
        switch = score[rows, best][:, None] - step
        back[t] = np.where(score >= switch, labels, best[:, None])
        score = np.maximum(score, switch) + padded[t]
    out = np.zeros((BLOCK, n_blocks), np.int64)
    now = leave
    for t in range(BLOCK - 1, -1, -1):
        out[t] = now
        if t:
            now = back[t][rows, now].astype(np.int64)
    inside = np.arange(BLOCK)[None, :] < size[:, None]
    return out.T[inside]


def _whole(chain, row: int, parts: list[tuple]) -> None:
    """One chain over all pieces of a long text."""
    scores, letters, begin, end = (np.concatenate(x) for x in zip(*parts, strict=True))
    chain(np.asarray([row]), np.asarray([0, len(scores)]), scores, letters, begin, end)


def label(docs: DataFrame, model: Model, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """(doc_id, lang_pred, score, spans) of each row.

    ``score`` is the share of the text's letters in spans of ``lang_pred``; ``spans``
    are (start, end, lang) in characters, from a span's first letter to its last word's end.
    """
    rows = docs.select("doc_id", "text")
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["doc_id"].dataType.simpleString()
    n_lang = len(model.languages)
    limit = max(100_000, int(SLICE_BYTES * min(1.0, (8 / max(1, n_lang)) ** 2)))
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()),
                                    ("lang", pa.string())]))

    def predict(batches):
        model = held.value
        number = {x: k for k, x in enumerate(model.languages)}
        for batch in batches:
            n = batch.num_rows
            weight = np.zeros((n, n_lang + 1))
            spans: list[list[tuple]] = [[] for _ in range(n)]

            def chain(rows, bounds, scores, letters, begin, end, weight=weight, spans=spans):
                """Label whole texts: ``rows`` with their words' scores and places."""
                path = viterbi(scores, bounds, penalty)
                if not len(path):
                    return
                own = np.repeat(rows, np.diff(bounds))
                np.add.at(weight, (own, path), letters)
                change = np.flatnonzero((np.diff(path, prepend=-1) != 0)
                                        | (np.diff(own, prepend=-1) != 0))
                last = np.append(change[1:], len(path)) - 1
                for row, a, b, label in zip(own[change].tolist(), begin[change].tolist(),
                                            end[last].tolist(), path[change].tolist(),
                                            strict=True):
                    spans[row].append((a, b, model.languages[label]))

            texts = strings(batch.column("text"))
            sizes = np.diff(utf8_parts(texts)[1])
            parts: list[tuple] = []  # words of the pieces of a long text, in order
            before, held_row = 0, -1
            for pieces, owner in text_pieces(texts, limit):
                x = _Letters(pieces)
                cut = np.diff(utf8_parts(pieces)[1]) != sizes[owner]
                bounds = np.searchsorted(x.row, np.arange(len(pieces) + 1)) if len(x.at) \
                    else np.zeros(len(pieces) + 1, np.int64)
                some = len(x.at) and n_lang
                scores = _word_scores(x, model) if some else np.zeros((0, max(1, n_lang)))
                letters = np.add.reduceat((x.kind > 1).astype(np.int64), x.word) if some else None
                begin = x.at[x.word] - x.off[x.row] if some else None
                end = begin + x.at[x.word + x.length - 1] + 1 - x.at[x.word] if some else None
                for k in np.flatnonzero(cut).tolist():
                    row = int(owner[k])
                    if row != held_row and parts:
                        _whole(chain, held_row, parts)
                        parts = []
                    before = 0 if row != held_row else before
                    held_row, w = row, slice(int(bounds[k]), int(bounds[k + 1]))
                    if some and w.stop > w.start:
                        parts.append((scores[w], letters[w], begin[w] + before, end[w] + before))
                    before += int(x.off[k + 1] - x.off[k])
                if some and not cut.all():
                    keep = ~np.repeat(cut, np.diff(bounds))
                    size = np.where(cut, 0, np.diff(bounds))
                    chain(owner, np.concatenate(([0], np.cumsum(size))), scores[keep],
                          letters[keep], begin[keep], end[keep])
            if parts:
                _whole(chain, held_row, parts)
            total = weight.sum(1)
            best = weight[:, :n_lang].argmax(1) if n_lang else np.zeros(n, np.int64)
            known = total > 0
            names = np.asarray([*model.languages, "und"], object)
            for row, s in enumerate(spans):
                if len(s) > 2 and s[0][2] == s[-1][2]:
                    host = number[s[0][2]]
                    if weight[row, host] >= HOST_SHARE * total[row]:
                        best[row] = host
            top = weight[np.arange(n), best] / np.maximum(total, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"),
                 pa.array(names[np.where(known, best, n_lang)].tolist(), pa.string()),
                 pa.array(np.where(known, top, 0.0)),
                 pa.array([[dict(start=a, end=b, lang=c) for a, b, c in s] if k else []
                           for s, k in zip(spans, known, strict=True)], span_type)],
                ["doc_id", "lang_pred", "score", "spans"])
            release_memory()

    return rows.mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double, "
                           "spans array<struct<start:long,end:long,lang:string>>")
