"""Benchmark decontamination (2): a positional inverted index of the training texts.

1. Every window of an item (``width`` words in a row; a shorter item is one window)
   takes its two rarest words by corpus frequency as its anchors.
2. One scan stores the index: for each text its word count and the postings
   (term, position) of the anchor terms, as Parquet in the shared folder.
3. Postings meet the item positions of their term; position minus item position is
   the offset-adjusted start.  Grouping by (document, item, start) intersects the
   lists: a window is a candidate where both its anchors share a start.
4. The texts that hold candidates are compared word by word, so the phrase matches
   are exact.  With ``slop`` >= 0, windows whose distinct words all lie within
   ``width + slop`` consecutive words are returned as proximity matches as well.

Words are found on UTF-8 bytes: a-z (A-Z lowered), 0-9 and every byte from 0x80.
Inside tasks a word is its 64-bit polynomial hash; the final comparison is of
128 bits per word (two polynomials).  Benchmark terms are broadcast in blocks of
items of at most ``block_words`` words, which bounds the broadcast at any size.

Defined cases: a null text has no words; an item with a null id takes no part;
items that share an id count as one id; rows that repeat a doc_id are judged each
by its own text; null doc_ids stay; ties in rarity go to the earlier word; further
columns are ignored; empty tables give no hits or no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import (
    byte_slices,
    join_side,
    release_memory,
    runs,
    stored,
    strings,
    utf8_parts,
)

WIDTH = 10
BLOCK_WORDS = 2_000_000
#: Candidate sets up to this many documents are broadcast to select texts (some 120 MB);
#: larger ones are joined by shuffle.
BROADCAST_DOCS = 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = True
_WORD[0x80:] = True
#: Odd multipliers of the two polynomial hashes.
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_power_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64, kept for the worker."""
    if which not in _power_tables or len(_power_tables[which][0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length()) if n else 1 << 16
        inverse = np.uint64(pow(int(_BASES[which]), -1, 1 << 64))
        _power_tables[which] = (_powers(_BASES[which], size), _powers(inverse, size))
    return _power_tables[which]


def word_hashes(texts: pa.Array, which: int = 0, chunk: int = 1 << 18
                ) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, word bounds by text).  Long buffers go chunk by chunk, cut
    between words, so the 64-bit work arrays stay small."""
    data, off = utf8_parts(texts)
    data = _LOWER[data]
    mask = _WORD[data]
    inner = np.unique(off[1:-1])
    inner = inner[(inner > 0) & (inner < len(data))]
    starts, ends = runs(mask)
    # a word never spans two texts
    if len(inner):
        split = inner[mask[inner] & mask[inner - 1]]
        starts = np.sort(np.concatenate([starts, split]))
        ends = np.sort(np.concatenate([ends, split]))
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + chunk, side="right")))
        lo, hi = int(starts[at]), int(ends[stop - 1])
        power, inverse = _tables(which, hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * power[:hi - lo],
                  out=total[1:])
        s, e = starts[at:stop] - lo, ends[at:stop] - lo
        x = (total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)
        out[at:stop] = x ^ (x >> np.uint64(29))
        at = stop
    return out, np.searchsorted(starts, off)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


class Terms:
    """Sorted term hashes with a bitmap before the search."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.bitmap = np.zeros(1 << 22, bool)
        self.bitmap[self.sorted >> np.uint64(42)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of the words that are terms, their term numbers)."""
        at = np.flatnonzero(self.bitmap[hashes >> np.uint64(42)])
        if not len(self.sorted):
            return at[:0], at[:0]
        number = np.searchsorted(self.sorted, hashes[at])
        number[number == len(self.sorted)] = 0
        same = self.sorted[number] == hashes[at]
        return at[same], number[same]


def _item_windows(items: pd.DataFrame, width: int) -> list[dict]:
    """Word hashes of the items that have words."""
    out = []
    texts = strings(pa.array(items["text"].tolist(), pa.large_string()))
    first, bounds = word_hashes(texts, 0)
    second, _ = word_hashes(texts, 1)
    for k, item_id in enumerate(items["item_id"]):
        a, b = bounds[k], bounds[k + 1]
        if b > a:
            out.append({"item_id": str(item_id), "h": first[a:b], "g": second[a:b],
                        "width": min(width, int(b - a))})
    return out


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[pd.DataFrame]:
    """Items in blocks of bounded text; an upper bound of the words is half the bytes."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text") \
        .filter(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    size = items.agg(F.sum((F.octet_length("text") + 2) / 2)).first()[0] or 0
    n = int(size // block_words) + 1
    for k in range(n):
        # by id and text: an id with many texts spreads over the blocks
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) \
            if n > 1 else items
        yield block.distinct().orderBy("item_id", "text").toPandas()


def _frequencies(docs: DataFrame, terms: Terms) -> dict[int, int]:
    """Corpus frequency of each benchmark term, combined in the tasks first."""
    held = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches):
        total = np.zeros(len(held.value.sorted), np.int64)
        for batch in batches:
            texts = strings(batch.column("text"))
            for start, stop in byte_slices(texts):
                hashes, _ = word_hashes(texts.slice(start, stop - start))
                _, number = held.value.find(hashes)
                total += np.bincount(number, minlength=len(total))
            release_memory()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(total[at])], ["term", "n"])

    rows = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term") \
        .agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in rows.toLocalIterator()}


def build_index(docs: DataFrame, terms: Terms) -> DataFrame:
    """The stored index: (doc_id, text_hash, n_words, postings) of each text."""
    held = docs.sparkSession.sparkContext.broadcast(terms)

    def postings(batches):
        for batch in batches:
            texts = strings(batch.column("text"))
            for start, stop in byte_slices(texts):
                hashes, bounds = word_hashes(texts.slice(start, stop - start))
                at, number = held.value.find(hashes)
                row_of = np.searchsorted(at, bounds)
                owner = np.searchsorted(bounds, at, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, stop - start),
                     batch.column("text_hash").slice(start, stop - start),
                     pa.array(np.diff(bounds)),
                     _lists(row_of, number), _lists(row_of, at - bounds[owner])],
                    ["doc_id", "text_hash", "n_words", "terms", "positions"])
            release_memory()

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return stored(rows.mapInArrow(
        postings, f"doc_id {kind}, text_hash long, n_words long, terms array<int>, "
        "positions array<int>"), "positional-index")


def _lists(bounds: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)),
                                    pa.array(values.astype(np.int32)))


def find_matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, slop: int = -1,
                 block_words: int = BLOCK_WORDS) -> tuple[DataFrame, list[DataFrame]]:
    """(word counts of all texts, matches of each block of items).

    Matches: doc_id, text_hash, item_id, start (word position in the document),
    n_words (of the window), kind ('phrase' or, with ``slop`` >= 0, 'proximity').
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    counts, found = None, []
    for block in _blocks(benchmark.select("item_id", "text"), block_words):
        items = _item_windows(block, width)
        terms = Terms(np.concatenate([x["h"] for x in items] or [np.zeros(0, np.uint64)]))
        frequency = _frequencies(docs, terms) if items else {}
        n = np.zeros(len(terms.sorted) + 1, np.int64)
        n[list(frequency)] = list(frequency.values())
        anchors = []  # (term, item, position in the item)
        pairs = []  # by item: the two anchors of each window
        for i, item in enumerate(items):
            number = np.searchsorted(terms.sorted, item["h"])
            rarity = n[number]
            own = []
            for w in range(len(number) - item["width"] + 1):
                span = rarity[w:w + item["width"]]
                if span.min() == 0:
                    continue  # a word that the corpus lacks: the window cannot occur
                order = np.argsort(span, kind="stable")[:2] + w
                own.append((w, int(order[0]), int(order[-1])))
            pairs.append(own)
            anchors += [(int(number[q]), i, q) for q in sorted({q for x in own for q in x[1:]})]
        chosen = sorted({t for t, _, _ in anchors})
        index = build_index(docs, Terms(terms.sorted[chosen]))
        counts = index.select("doc_id", "text_hash", "n_words") if counts is None else counts
        if not anchors:
            continue
        position = {t: k for k, t in enumerate(chosen)}
        table = spark.createDataFrame(
            pd.DataFrame([(position[t], i, q) for t, i, q in anchors],
                         columns=["term", "item", "q"]), "term int, item int, q int")
        posting = index.select("doc_id", "text_hash", F.explode(
            F.arrays_zip("terms", "positions")).alias("x")).select(
            "doc_id", "text_hash", F.col("x.terms").alias("term"), F.col("x.positions").alias("p"))
        # bounded by block_words rows, so it may be broadcast at any corpus size
        starts = posting.join(F.broadcast(table), "term").groupBy(
            "doc_id", "text_hash", "item", (F.col("p") - F.col("q")).alias("start")).agg(
            F.collect_set("q").alias("qs"))
        if slop < 0:
            windows = spark.createDataFrame(
                pd.DataFrame([(i, a, b) for i, own in enumerate(pairs) for _, a, b in own],
                             columns=["item", "a", "b"]).drop_duplicates(),
                "item int, a int, b int")
            starts = starts.join(F.broadcast(windows.groupBy("item").agg(
                F.collect_list(F.struct("a", "b")).alias("ab"))), "item").filter(F.exists(
                    "ab", lambda x: F.array_contains("qs", x["a"])
                    & F.array_contains("qs", x["b"])))
        candidates = stored(starts.groupBy("doc_id", "text_hash").agg(
            F.collect_list(F.struct("item", "start")).alias("found")), "candidates")
        found.append(_verify(docs, candidates, items, slop))
    if counts is None:
        counts = build_index(docs, Terms(np.zeros(0, np.uint64))).select(
            "doc_id", "text_hash", "n_words")
    return counts, found


def _verify(docs: DataFrame, candidates: DataFrame, items: list[dict], slop: int) -> DataFrame:
    """Compare the texts that hold candidates word by word."""
    texts = docs.withColumn("text_hash", F.xxhash64("text"))
    on = F.expr("doc_id <=> c_doc and text_hash = c_hash")
    few = candidates.count() <= BROADCAST_DOCS
    keys = candidates.select(F.col("doc_id").alias("c_doc"), F.col("text_hash").alias("c_hash"),
                             "found")
    if few:  # only the keys are broadcast: the candidates may hold many starts
        texts = texts.join(F.broadcast(keys.drop("found")), on, "left_semi")
    rows = texts.join(join_side(keys, few=False), on).select(
        "doc_id", "text_hash", "text", "found")
    held = docs.sparkSession.sparkContext.broadcast(items)

    def compare(batches):
        for batch in batches:
            texts = strings(batch.column("text"))
            out: list[tuple] = []
            for start, stop in byte_slices(texts):
                part = texts.slice(start, stop - start)
                first, bounds = word_hashes(part, 0)
                second, _ = word_hashes(part, 1)
                for k in range(stop - start):
                    a, b = bounds[k], bounds[k + 1]
                    for match in _matches(first[a:b], second[a:b],
                                          batch.column("found")[start + k].as_py(),
                                          held.value, slop):
                        out.append((start + k, *match))
            row = pa.array([x[0] for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(row), batch.column("text_hash").take(row),
                 pa.array([x[1] for x in out], pa.string()),
                 pa.array([x[2] for x in out], pa.int64()),
                 pa.array([x[3] for x in out], pa.int64()),
                 pa.array([x[4] for x in out], pa.string())],
                ["doc_id", "text_hash", "item_id", "start", "n_words", "kind"])
            release_memory()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(compare, f"doc_id {kind}, text_hash long, item_id string, "
                           "start long, n_words long, kind string")


def _matches(first, second, candidates, items, slop):
    """Matches of one text: exact windows at candidate starts, then windows within a span."""
    n = len(first)
    near: dict[int, set] = {}
    for c in candidates:
        item, start = items[c["item"]], c["start"]
        lo, hi = max(0, -start), min(len(item["h"]), n - start)
        if hi <= lo:
            continue
        same = (first[start + lo:start + hi] == item["h"][lo:hi]) \
            & (second[start + lo:start + hi] == item["g"][lo:hi])
        run_starts, run_ends = runs(same)
        for a, b in zip(run_starts, run_ends, strict=True):
            for at in range(a, b - item["width"] + 1):
                yield item["item_id"], int(start + lo + at), item["width"], "phrase"
        near.setdefault(c["item"], set()).add(start)
    if slop < 0:
        return
    for i, starts in near.items():
        item = items[i]
        for w in range(len(item["h"]) - item["width"] + 1):
            words = set(item["h"][w:w + item["width"]].tolist())
            seen = set()
            for s in starts:
                lo = max(0, s + w - item["width"] - slop)
                hi = min(n, s + w + 2 * item["width"] + slop)
                for at in _spans(first[lo:hi], words, item["width"] + slop):
                    seen.add(lo + at)
            for at in sorted(seen):
                yield item["item_id"], int(at), item["width"], "proximity"


def _spans(hashes: np.ndarray, words: set, span: int) -> Iterator[int]:
    """Starts of the shortest stretches that hold all words within ``span`` positions."""
    at = [k for k, h in enumerate(hashes.tolist()) if h in words]
    count: dict[int, int] = {}
    left = 0
    for right in range(len(at)):
        h = int(hashes[at[right]])
        count[h] = count.get(h, 0) + 1
        while len(count) == len(words):
            if at[right] - at[left] < span:
                yield at[left]
            gone = int(hashes[at[left]])
            count[gone] -= 1
            if not count[gone]:
                del count[gone]
            left += 1


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row for each document row: n_words, n_hit, n_items, items (sorted ids),
    contaminated."""
    docs = docs.select("doc_id", "text")
    counts, found = find_matches(docs, benchmark, width)
    empty = counts.select(
        "doc_id", "text_hash", F.lit(None).cast("string").alias("item_id"),
        F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_words")).limit(0)
    matches = empty
    for block in found:
        matches = matches.unionByName(block.filter("kind = 'phrase'").drop("kind"))
    # a text's own matches only: bounded by its words
    hits = matches.distinct().groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set("item_id")).alias("items"),
        F.array_sort(F.collect_set(F.struct("start", "n_words"))).alias("spans"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("to")),
        lambda acc, x: F.struct(
            (acc["hit"] + F.greatest(F.lit(0).cast("long"), x["start"] + x["n_words"]
                                     - F.greatest(acc["to"], x["start"]))).alias("hit"),
            F.greatest(acc["to"], x["start"] + x["n_words"]).alias("to")), lambda acc: acc["hit"])
    hits = hits.select(F.col("doc_id").alias("h_doc"), F.col("text_hash").alias("h_hash"),
                       "items", covered.alias("hit"))
    # where only texts with hits are asked for, Spark would broadcast all word counts
    joined = counts.join(join_side(hits, few=False),
                         F.expr("doc_id <=> h_doc and text_hash = h_hash"), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "text_hash", "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"), items.alias("items"),
        (F.coalesce("hit", F.lit(0)) > 0).alias("contaminated"))
