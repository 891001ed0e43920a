"""Quality classifier (9): learning from positives and unlabelled text.

Each text becomes shares of byte classes, repetition and length figures, and
hashed byte-pair frequencies, all over the whole text.  Training takes a bounded
sample (``positives`` trusted rows, ``unlabelled`` web rows, chosen among the distinct
(doc_id, text) by their hash, so no repeated id can widen it) and minimises the non-negative unbiased risk of a logistic scorer

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

by Adam with full batches.  ``prior``, the share of positives in web text, is estimated from
the two samples alone (``estimated_prior``); labelled negatives are never used.  The score is
the scorer's probability.

Defined cases: null text counts as empty and is scored like any text; without
positives every score is 0.5; rows that repeat a doc_id are scored each, and a
repeated label counts once (its largest value); null ids carry no label; further
columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import (
    hash_share,
    join_side,
    release_memory,
    stored,
    strings,
    text_pieces,
    utf8_parts,
)

PAIRS = 512
POSITIVES = 8_000
UNLABELLED = 8_000
SUMS = 14  # additive figures of a text
THRESHOLD = 0.3
PIECE_BYTES = 1_000_000  # text whose work arrays are held at once

_CLASS = np.zeros(256, np.uint8)  # 0 control and other
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[0x41:0x5B] = 3
_CLASS[0x61:0x7B] = 4
_CLASS[0x80:] = 5
for _c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _CLASS[_c] = 6
for _c in b".,;:'-":
    _CLASS[_c] = 7
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _pair_cell(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77))
            * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - 9)


@lru_cache(maxsize=1)
def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    return tuple(np.concatenate((np.ones(1, np.uint64), np.cumprod(
        np.full(n - 1, x, np.uint64)))) for x in (_BASE, inverse))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    up, down = _power_table(1 << max(20, (n - 1).bit_length()))
    return up[:n], down[:n]


def _word_keys(data: np.ndarray, off: np.ndarray, kind: np.ndarray, low: np.ndarray):
    """(first byte, size, hash, text) of each word of a slice."""
    lengths = np.diff(off)
    word = kind != 1
    edge = np.zeros(len(data) + 1, bool)
    edge[off[:-1][lengths > 0]] = True
    begin = np.flatnonzero(word & (edge[:-1] | ~np.concatenate(([False], word[:-1]))))
    if not len(begin):
        return begin, begin, np.zeros(0, np.uint64), begin
    # bytes weighted by powers of the base, which the word's first power is divided out of
    up, down = _powers(len(data))
    value = np.where(word, (low.astype(np.uint64) + np.uint64(1)) * up, np.uint64(0))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
    stop = np.append(begin[1:], len(data))
    size = np.add.reduceat(word.astype(np.int64), begin)
    mix = (total[stop] - total[begin]) * down[begin] + size.astype(np.uint64)
    mix = (mix ^ mix >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return begin, size, mix, np.searchsorted(off, begin, side="right") - 1


class _LongText:
    """What joins the pieces of a text that is cut: the byte pair and the repeated word over
    each cut, and the words that further pieces have seen already."""

    def __init__(self):
        self.seen = np.zeros(0, np.uint64)
        self.last_byte = self.last_word = None

    def correct(self, piece: pa.Array, sums: np.ndarray, pairs: np.ndarray) -> None:
        """Make the figures of the next piece those of its part of the whole text."""
        data, off = utf8_parts(piece)
        if not len(data):
            return
        kind = _CLASS[data]
        low = np.where(kind == 3, data + 32, data).astype(np.uint32)
        if self.last_byte is not None:
            pairs[_pair_cell(self.last_byte, low[:1])[0]] += 1
        self.last_byte = low[-1:]
        begin, _, mix, _ = _word_keys(data, off, kind, low)
        if not len(begin):
            return
        # a piece ends after white space, so no word is cut
        sums[9] += self.last_word is not None and mix[0] == self.last_word
        self.last_word = mix[-1]
        before = len(self.seen)
        self.seen = np.union1d(self.seen, mix >> np.uint64(24))
        sums[10] = len(self.seen) - before


def _sums(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Additive figures and byte-pair counts of each text of a slice."""
    data, off = utf8_parts(texts)
    n = len(texts)
    lengths = np.diff(off)
    row = np.repeat(np.arange(n), lengths)
    out = np.zeros((n, SUMS))
    out[:, 0] = lengths
    kind = _CLASS[data]
    for c in range(1, 8):
        out[:, c] = np.bincount(row[kind == c], minlength=n)
    pairs = np.zeros((n, PAIRS))
    if not len(data):
        return out, pairs
    # adjacent byte pairs, letters folded to one case
    low = np.where(kind == 3, data + 32, data).astype(np.uint32)
    h = _pair_cell(low[:-1], low[1:])
    same = row[:-1] == row[1:]
    pairs += np.bincount(row[:-1][same].astype(np.int64) * PAIRS + h[same],
                         minlength=n * PAIRS).reshape(n, PAIRS)
    begin, size, mix, owner = _word_keys(data, off, kind, low)
    if len(begin):
        out[:, 8] = np.bincount(owner, minlength=n)
        again = (mix[1:] == mix[:-1]) & (owner[1:] == owner[:-1])
        out[:, 9] = np.bincount(owner[1:][again], minlength=n)
        key = (mix >> np.uint64(24)) + (owner.astype(np.uint64) << np.uint64(44))
        out[:, 10] = np.bincount((np.unique(key) >> np.uint64(44)).astype(np.int64),
                                 minlength=n)[:n]
        out[:, 11] = np.bincount(owner, size, n)
        shout = (kind[begin] == 3) & (kind[np.minimum(begin + 1, len(data) - 1)] == 3)
        out[:, 12] = np.bincount(owner[shout], minlength=n)
        mark = kind[begin + size - 1] == 6
        out[:, 13] = np.bincount(owner[mark], minlength=n)
    return out, pairs


def features(texts: pa.Array) -> np.ndarray:
    """One row of features for each text; the pieces of long texts add up to the whole's."""
    n = len(texts)
    sums, pairs = np.zeros((n, SUMS)), np.zeros((n, PAIRS))
    sizes = np.diff(utf8_parts(texts)[1])
    long: dict[int, _LongText] = {}
    for pieces, owner in text_pieces(texts, PIECE_BYTES):
        a, b = _sums(pieces)
        cut = np.diff(utf8_parts(pieces)[1]) != sizes[owner]
        for k in np.flatnonzero(cut):
            long.setdefault(int(owner[k]), _LongText()).correct(pieces.slice(int(k), 1), a[k], b[k])
        np.add.at(sums, owner, a)
        np.add.at(pairs, owner, b)
    length = np.maximum(sums[:, :1], 1)
    words = np.maximum(sums[:, 8:9], 1)
    return np.concatenate([
        np.log1p(sums[:, :1]) / 10, sums[:, 1:8] / length, sums[:, 9:11] / words,
        np.sqrt(sums[:, 9:10] / words), sums[:, 11:12] / words / 10, sums[:, 12:14] / words,
        np.sqrt(sums[:, 12:14] / words), sums[:, 10:11] / np.sqrt(words) / 10,
        np.sqrt(pairs / length)], axis=1).astype(np.float32)


@dataclass
class Scorer:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -50, 50)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.1) -> float:
    """Share of positives in unlabelled text, from scores alone (no labelled negatives).

    Where a share ``p`` of the unlabelled are positives, at least ``p`` times the positives'
    share of any score range is found among the unlabelled.  So over all thresholds that a
    share ``least`` of the positives passes, the smallest ratio of the two shares bounds the
    prior from above, and is close to it where some range holds hardly any negatives."""
    if not len(positive) or not len(unlabelled):
        return 0.5
    at = np.quantile(positive, np.linspace(0, 1 - least, 200))
    p = 1 - np.searchsorted(np.sort(positive), at, side="left") / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), at, side="left") / len(unlabelled)
    return float(min(0.99, max(0.01, (u / p).min())))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400,
        rate: float = 0.03, decay: float = 1e-3) -> Scorer:
    """Non-negative risk minimisation; where the negative part falls below zero, its
    gradient is followed upwards instead (the published correction)."""
    width = unlabelled.shape[1]
    if not len(positive) or not len(unlabelled):
        return Scorer(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    # single precision halves the time; sums of thousands of rows leave it precise enough
    xp, xu = (((x - mean) / scale).astype(np.float32) for x in (positive, unlabelled))
    w = np.zeros(width + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        w32 = w.astype(np.float32)
        zp = (xp @ w32[:-1] + w32[-1]).astype(np.float64)
        zu = (xu @ w32[:-1] + w32[-1]).astype(np.float64)
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -50, 50))), 1 / (1 + np.exp(-np.clip(zu, -50, 50)))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        up = np.append(su.astype(np.float32) @ xu, su.sum()) / len(su) \
            - prior * np.append(sp.astype(np.float32) @ xp, sp.sum()) / len(sp)
        down = prior * np.append((sp - 1).astype(np.float32) @ xp, (sp - 1).sum()) / len(sp)
        gradient = down + up if negative >= 0 else -up
        gradient[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient ** 2
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return Scorer(mean, scale, w[:-1], float(w[-1]))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, rounds: int = 2,
                    steps: int = 100) -> float:
    """Class prior from features: halves are scored by a fit on the other half, the scores
    bound the prior, and the next fit starts from that."""
    prior = 0.5
    for _ in range(rounds):
        scores = [[], []]
        for half in (0, 1):
            scorer = fit(positive[half::2], unlabelled[half::2], prior, steps)
            for k, x in enumerate((positive, unlabelled)):
                scores[k].append(scorer.score(x[1 - half::2]))
        prior = class_prior(*(np.concatenate(x) for x in scores))
    return prior


def train(docs: DataFrame, labels: DataFrame, where: Column, positives: int = POSITIVES,
          unlabelled: int = UNLABELLED) -> Scorer:
    """``where`` selects, by doc_id, the rows whose labels may be learned."""
    marks = labels.select("doc_id", "quality").filter(
        where & F.col("doc_id").isNotNull() & F.col("quality").isNotNull()) \
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    pairs = stored(docs.select("doc_id", "text_hash").distinct(), "id-text-pairs")
    positive = pairs.join(join_side(marks.filter(F.col("quality") == 1).select("doc_id"),
                                    few=False), "doc_id")
    trusted = positive.filter(hash_share(F.struct("doc_id", "text_hash"),
                                         min(1.0, positives / max(1, positive.count()))))
    web = pairs.filter(F.coalesce(where, F.lit(False)) & hash_share(
        F.struct(F.lit("web"), "doc_id", "text_hash"),
        min(1.0, unlabelled / max(1, pairs.count()))))
    # at most about ``positives`` + ``unlabelled`` pairs: a bounded broadcast
    chosen = trusted.select("doc_id", "text_hash", F.lit(True).alias("trusted"),
                            F.lit(False).alias("web")).unionByName(
        web.select("doc_id", "text_hash", F.lit(False).alias("trusted"),
                   F.lit(True).alias("web"))).groupBy("doc_id", "text_hash").agg(
        F.max("trusted").alias("trusted"), F.max("web").alias("web")).select(
        F.col("doc_id").alias("c_doc"), F.col("text_hash").alias("c_hash"), "trusted", "web")
    rows = docs.join(F.broadcast(chosen), F.expr("doc_id <=> c_doc and text_hash = c_hash")) \
        .groupBy("doc_id", "text_hash").agg(*[F.min(c).alias(c) for c in
                                              ("text", "trusted", "web")])

    def measure(batches):
        for batch in batches:
            x = features(strings(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("trusted"), batch.column("web"),
                 pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(
                     pa.list_(pa.float32()))], ["trusted", "web", "x"])
            release_memory()

    got = rows.mapInArrow(measure, "trusted boolean, web boolean, x array<float>").toArrow()
    x = got.column("x").combine_chunks().flatten().to_numpy() if got.num_rows else np.zeros(0)
    x = x.reshape(got.num_rows, -1) if got.num_rows else np.zeros((0, _width()))
    order = np.lexsort(x.T[:8])  # the order in which tasks end must not change the fit
    x, is_p, is_u = x[order], got.column("trusted").to_numpy()[order], \
        got.column("web").to_numpy()[order]
    positive, web = x[is_p], x[is_u]
    del got, x
    scorer = fit(positive, web, estimated_prior(positive, web))
    del positive, web
    release_memory()  # the driver goes on with other work
    return scorer


def _width() -> int:
    return features(pa.array([""], pa.large_string())).shape[1]


def score(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD,
          keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id if not given) with score and predicted, which replace kept
    columns of these names."""
    keep = [c for c in keep or ["doc_id"] if c not in ("score", "predicted")]
    held = docs.sparkSession.sparkContext.broadcast(scorer)
    rows = docs.select(*keep, *(["text"] if "text" not in keep else []))

    def judge(batches):
        for batch in batches:
            texts = strings(batch.column("text"))
            s = held.value.score(features(texts)) if len(texts) else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(s),
                 pa.array((s >= threshold).astype(np.int32))], [*keep, "score", "predicted"])
            release_memory()

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(judge, f"{kinds}, score double, predicted int")
