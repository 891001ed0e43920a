"""LM scoring (3): prediction by partial matching over a byte-context trie.

Training counts every (order + 1)-byte string of the training texts (lowered A-Z,
``order`` bytes of padding in front, one end symbol 0xFF, which UTF-8 never holds).
Counts of shorter contexts are marginal sums of these.  ``score`` uses every count,
however rare the string and however large the corpus.

A symbol's probability: from the longest known context c, (n(c, s) - 1/2) / N, where N
is all that followed c.  The escape count E takes the half that each symbol gives up
(method D).  If s never followed c, E / N is paid and the next
shorter context is tried without the symbols just excluded, whose counts leave its N;
below order 0 all remaining byte values are equally likely.  These
probabilities sum to one.  All exclusion totals depend on the context alone, so they
are computed once per trie node.

Where the work is done: a symbol's probability depends on its string alone, and only on
counts of strings with the same last bytes.

1. Texts fall into chunks of ``CHUNK_BYTES``, by their place in their scan task.  A chunk's
   distinct strings, with their training counts, go to shards by their last ``ROOT`` context
   bytes (``HOT_SHARE``: contexts that hold more than that share of all positions go by one
   byte more, as theirs alone would be a large shard).
2. A shard adds up the counts of its strings over all chunks, builds their trie over the
   shorter contexts (at most 256**ROOT strings, which all shards hold, besides the at most 256
   symbols after each hot context) and answers every chunk with the logarithms of its strings.
3. A chunk's texts meet its answers and are added up.

So every string is answered once per chunk, whatever its frequency; nothing is cached, capped
or left out, and what a task holds depends on a chunk or a shard alone.  ``docs`` is scanned
three times and has to give the same rows in the same order each time, as files do.

The base model is the smoothed unigram of words.  Words with at least a
2**-``WORD_BITS`` share of all training words (at most 2**WORD_BITS of them) are
looked up inside the tasks; the others join the full count table by word.

Adaptive scoring (``adaptive_log10``) codes a text with a trie that it fills itself.

Defined cases: null text counts as empty and is one end symbol; a null doc_id counts
as held out; with nothing learned every byte has probability 1/256 and the base has
N = V = 0; repeated rows count and are scored each; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import (
    SLICE_BYTES,
    byte_slices,
    release_memory,
    stored,
    strings,
    text_pieces,
    utf8_parts,
)

ORDER = 6
DISCOUNT = 0.5
PENDING = 1_200_000  # counted strings that a task holds before it hands them on
ROOT = 3  # context bytes that a shard's strings share
HOT_SHARE = 1 / 256  # of all positions: contexts above it are dealt out by one byte more
SHARD_POSITIONS = 1 << 23  # positions for each shard
MAX_SHARDS = 1 << 18  # a chunk sends no more than so many pieces
CHUNK_BYTES = 32_000_000  # of text, whose distinct strings a task holds at a time
WORD_BITS = 19
COUNT_CHUNK, SCORE_CHUNK = 1_000_000, 250_000  # positions whose work arrays are held at once
END = 0xFF
_MIX = np.uint64(0x9E3779B97F4A7C15)


# ------------------------------------------------------------ strings of bytes ----
def _grams(texts: pa.Array, order: int, chunk: int = COUNT_CHUNK):
    """Chunks (grams, text of each gram): every position's byte with the ``order`` before."""
    pad = bytes([END]) * order
    raw = [x.as_buffer().to_pybytes() if x.is_valid else b""
           for x in pc.ascii_lower(texts).cast(pa.large_binary())]
    # one more padding in front, so every window has the bytes before it
    buffer = np.frombuffer(pad + b"".join(pad + x + b"\xff" for x in raw), np.uint8)
    ends = np.cumsum(np.diff(utf8_parts(texts)[1]) + 1 + order)
    starts = np.concatenate(([0], ends[:-1]))
    total = int(ends[-1]) if len(ends) else 0
    for at in range(0, total, chunk):
        stop = min(total, at + chunk)
        wide = buffer[at:stop + order].astype(np.uint64)
        gram = wide[:stop - at].copy()
        for back in range(1, order + 1):
            gram <<= np.uint64(8)
            gram |= wide[back:stop - at + back]
        first, last = np.searchsorted(ends, [at, stop - 1], side="right")
        inside = np.arange(first, last + 1)
        begin = np.maximum(starts[inside], at)
        text = np.repeat(inside, np.minimum(ends[inside], stop) - begin)
        real = np.ones(stop - at, bool)
        padding = (starts[inside][:, None] + np.arange(order)).ravel() - at
        real[padding[(padding >= 0) & (padding < stop - at)]] = False
        yield gram[real], text[real]


class _Runs:
    """Counted strings, gathered as sorted runs; runs of similar size are merged."""

    def __init__(self):
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, value: np.ndarray, n: np.ndarray) -> None:
        self.runs.append((value, n))
        while len(self.runs) > 1 and len(self.runs[-2][0]) < 2 * len(self.runs[-1][0]):
            last = self.runs.pop()
            self.runs[-1] = _add(*self.runs[-1], *last)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """All of them as one sorted run; none are left."""
        while len(self.runs) > 1:
            last = self.runs.pop()
            self.runs[-1] = _add(*self.runs[-1], *last)
        return self.runs.pop() if self.runs else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _add(value: np.ndarray, n: np.ndarray, new: np.ndarray, times: np.ndarray
         ) -> tuple[np.ndarray, np.ndarray]:
    """Counts of two sorted sets of strings together; the arrays given may be changed."""
    if len(value) < len(new):
        value, n, new, times = new, times, value, n
    if not len(new):
        return value, n
    at = np.searchsorted(value, new)
    known = value[np.minimum(at, len(value) - 1)] == new
    n[at[known]] += times[known]
    fresh = ~known
    at = at[fresh]
    return np.insert(value, at, new[fresh]), np.insert(n, at, times[fresh])


def count_grams(docs: DataFrame, where: Column, order: int = ORDER,
                contexts: np.ndarray | None = None) -> DataFrame:
    """(gram, n) over all training texts, combined in the tasks before the shuffle; with
    ``contexts`` (sorted) only of strings whose ``order`` bytes before the last are one."""
    def count(batches):
        held = _Runs()
        if contexts is not None:  # of ROOT bytes
            wanted = np.zeros(1 << 8 * order, bool)
            wanted[contexts] = True
        for batch in batches:
            texts = strings(batch.column("text"))
            for start, stop in byte_slices(texts):
                for gram, _ in _grams(texts.slice(start, stop - start), order):
                    if contexts is not None:
                        gram = gram[wanted[gram >> np.uint64(8)]]
                    held.add(*np.unique(gram, return_counts=True))
            release_memory()
            if sum(len(v) for v, _ in held.runs) > PENDING:
                yield _counted(*held.take())
                held = _Runs()
        yield _counted(*held.take())

    return docs.filter(where).select("text").mapInArrow(count, "gram long, n long") \
        .groupBy("gram").agg(F.sum("n").alias("n"))


def _counted(value: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n"])


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    return known[np.minimum(at, len(known) - 1)] == values


# ---------------------------------------------------------------------- trie ----
class Table:
    """Open addressing from uint64 keys to rows, filled and read by whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(8, (3 * len(keys) // 2).bit_length())
        self.key = np.full(1 << self.bits, ~np.uint64(0), np.uint64)
        self.row = np.zeros(1 << self.bits, np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = self.key[slot] == ~np.uint64(0)
            self.key[slot[free]] = keys[left[free]]
            own = self.key[slot] == keys[left]
            self.row[slot[own]] = left[own]
            left, slot = left[~own], (slot[~own] + 1) & (len(self.key) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 if it is not held."""
        slot = self._slot(keys)
        seen = self.key[slot]
        out = np.where(seen == keys, self.row[slot], -1)
        left = np.flatnonzero((seen != keys) & (seen != ~np.uint64(0)))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (len(self.key) - 1)
            seen = self.key[slot]
            own = seen == keys[left]
            out[left[own]] = self.row[slot[own]]
            go = ~own & (seen != ~np.uint64(0))
            left, slot = left[go], slot[go]
        return out


@dataclass
class Level:
    """Entries and contexts of one order; logarithms to base 10."""
    entries: Table
    count: np.ndarray  # log10 (n - 1/2) of an entry
    contexts: Table
    whole: np.ndarray  # log10 N
    escape: np.ndarray  # log10 E
    rest_whole: np.ndarray  # the same for the shorter context without this one's symbols
    rest_escape: np.ndarray


class Trie:
    """A scorer from counts: ``levels[k]`` has entries of k context bytes and a symbol."""

    def __init__(self, entries: list[tuple[np.ndarray, np.ndarray]],
                 contexts: list[tuple[np.ndarray, np.ndarray]]):
        self.order = len(entries) - 1
        self.levels: list[Level] = []
        shorter = None
        for k, ((gram, n), (context, total)) in enumerate(zip(entries, contexts, strict=True)):
            table, nodes = Table(gram), Table(context)
            of = nodes.find(gram >> np.uint64(8))
            kept = np.bincount(of, n, len(context))
            symbols = np.bincount(of, minlength=len(context))
            dropped = total - kept
            if shorter is None:
                rest = (256.0 - symbols,) * 2  # all other byte values
            else:
                mask = np.uint64((1 << 8 * k) - 1)
                e_table, e_n, c_table, c_kept, c_symbols, c_dropped = shorter
                parent = c_table.find(context & (mask >> np.uint64(8)))
                taken = np.bincount(of, e_n[e_table.find(gram & mask)], len(context))
                rest = (c_kept[parent] - taken + c_dropped[parent],
                        DISCOUNT * (c_symbols[parent] - symbols) + c_dropped[parent])
            with np.errstate(divide="ignore"):
                self.levels.append(Level(
                    table, np.log10(n - DISCOUNT), nodes,
                    np.log10(total), np.log10(DISCOUNT * symbols + dropped),
                    np.log10(rest[0]), np.log10(rest[1])))
            shorter = (table, n.astype(np.float64), nodes, kept, symbols, dropped)

    def log10(self, gram: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's last byte after the bytes before it."""
        out = np.zeros(len(gram))
        left = np.arange(len(gram))
        whole = np.full(len(gram), np.nan)  # of the context in turn, NaN: none excluded yet
        escape = np.full(len(gram), np.nan)
        for k in range(self.order, -1, -1):
            level = self.levels[k]
            key = gram[left] & np.uint64((1 << 8 * (k + 1)) - 1)
            row = level.entries.find(key)
            node = level.contexts.find(key >> np.uint64(8))
            known = node >= 0
            fresh = known & np.isnan(whole)
            whole[fresh], escape[fresh] = level.whole[node[fresh]], level.escape[node[fresh]]
            hit = row >= 0
            out[left[hit]] += level.count[row[hit]] - whole[hit]
            # a context whose symbols are all excluded is passed without cost
            paid = ~hit & known & np.isfinite(whole)
            out[left[paid]] += escape[paid] - whole[paid]
            whole[known] = level.rest_whole[node[known]]
            escape[known] = level.rest_escape[node[known]]
            go = ~hit
            left, whole, escape = left[go], whole[go], escape[go]
        # the remaining byte values, equally likely; 256 of them if nothing was learned
        out[left] -= np.where(np.isnan(whole), math.log10(256), whole)
        return out


def _sums(gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct strings, sorted, with the sum of their counts."""
    value, of = np.unique(gram, return_inverse=True)
    return value, np.bincount(of, n, len(value)).astype(np.int64)


def _levels(gram: np.ndarray, n: np.ndarray, orders: range) -> tuple[list, list]:
    """Entries and contexts of ``orders`` (ascending) from counted strings of the last."""
    entries, contexts = [], []
    for k in reversed(orders):
        gram, n = _sums(gram & np.uint64((1 << 8 * (k + 1)) - 1), n)
        entries.insert(0, (gram, n))
        contexts.insert(0, _sums(gram >> np.uint64(8), n))
    return entries, contexts


_LOW3 = np.uint64((1 << 24) - 1)


def _turned(gram: np.ndarray) -> np.ndarray:
    """The last three context bytes first, then the earlier ones and the symbol: strings of a
    shard that follow each other differ little."""
    return ((gram >> np.uint64(8) & _LOW3) << np.uint64(32)
            | (gram >> np.uint64(32)) << np.uint64(8) | gram & np.uint64(0xFF))


def _unturned(value: np.ndarray) -> np.ndarray:
    return ((value >> np.uint64(8) & _LOW3) << np.uint64(32)
            | (value >> np.uint64(32)) << np.uint64(8) | value & np.uint64(0xFF))


def _packed(values: np.ndarray) -> bytes:
    """Sorted values as differences, byte plane by byte plane, which compresses well."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(data, np.uint8).reshape(size, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


@dataclass
class Roots:
    """What all shards hold: entries and contexts of the orders below ``ROOT``, the hot
    contexts of ``ROOT`` bytes (sorted), and the counted symbols after them."""
    entries: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    hot: np.ndarray
    hot_entries: tuple[np.ndarray, np.ndarray]
    shards: int

    def shard_of(self, gram: np.ndarray) -> np.ndarray:
        context = gram >> np.uint64(8) & _LOW3
        longer = gram >> np.uint64(8) & np.uint64((1 << 32) - 1) | np.uint64(1 << 40)
        key = np.where(_among(context, self.hot), longer, context)
        return ((key * _MIX >> np.uint64(33)) % np.uint64(self.shards)).astype(np.int32)

    def trie(self, gram: np.ndarray, n: np.ndarray, order: int) -> Trie:
        """Trie of a shard's counted strings; the symbols after hot contexts, of which a shard
        has only some, are taken from the whole."""
        first = len(self.entries)
        entries, contexts = _levels(gram, n, range(first, order + 1))
        if len(self.hot) and entries:
            known, times = entries[0]
            mine = np.unique(known >> np.uint64(8))
            mine = mine[_among(mine, self.hot)]
            local = ~_among(known >> np.uint64(8), mine)
            whole, sums = self.hot_entries
            extra = _among(whole >> np.uint64(8), mine)
            entries[0] = _sums(np.concatenate([known[local], whole[extra]]),
                               np.concatenate([times[local], sums[extra]]))
            contexts[0] = _sums(entries[0][0] >> np.uint64(8), entries[0][1])
        return Trie(self.entries + entries, self.contexts + contexts)


def learn_roots(docs: DataFrame, where: Column, order: int = ORDER) -> Roots:
    """At most 256**ROOT counted strings, and 256 for each of at most 1 / HOT_SHARE hot
    contexts, come to the driver."""
    def collected(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        table = counts.toArrow()
        return (table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy())

    low = min(order, ROOT - 1)
    entries, contexts = _levels(*collected(count_grams(docs, where, low)), range(low + 1))
    string, n = entries[low]
    positions = int(n.sum())
    # a string of ROOT bytes is a context as often as it occurs before a further byte
    hot = np.sort(string[n > positions * HOT_SHARE]) if order > ROOT else string[:0]
    after = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if len(hot):
        after = collected(count_grams(docs, where, ROOT, hot))
    whole = docs.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1)).first()[0] or 0
    return Roots(entries, contexts, hot, after,
                 max(1, min(MAX_SHARDS, -(-whole // SHARD_POSITIONS))))


# -------------------------------------------------------------------- chunks ----
def _by_chunk(batches, chunk_bytes: int):
    """(chunk, batch) of consecutive rows: a task's rows are cut where their bytes add up to
    multiples of ``chunk_bytes``, however they are batched."""
    task, before = TaskContext.get().partitionId() << 36, 0
    for batch in batches:
        sizes = np.diff(utf8_parts(strings(batch.column("text")))[1]) + 1
        number = (before + np.cumsum(sizes) - sizes) // chunk_bytes
        before += int(sizes.sum())
        cut = np.flatnonzero(np.diff(number)) + 1
        for start, stop in zip([0, *cut], [*cut, len(number)], strict=True):
            if stop > start:
                yield task + int(number[start]), batch.slice(start, stop - start)


def _distinct(runs: _Runs, texts: pa.Array, learn: np.ndarray, order: int) -> None:
    """Add the strings of ``texts``, turned; those of texts that are not learned count 0."""
    for start, stop in byte_slices(texts):
        for learned in (True, False):
            own = texts.slice(start, stop - start).filter(
                pa.array(learn[start:stop] == learned))
            for gram, _ in _grams(own, order):
                value, n = np.unique(_turned(gram), return_counts=True)
                runs.add(value, n if learned else np.zeros(len(n), np.int64))


def string_answers(docs: DataFrame, roots: Roots, order: int = ORDER) -> DataFrame:
    """(chunk, grams, log10), both binary: each chunk's distinct strings and their logarithms.
    ``docs`` has text and held_out."""
    held = docs.sparkSession.sparkContext.broadcast(roots)
    chunk_bytes = CHUNK_BYTES

    def pieces(batches):
        roots = held.value

        def sent(chunk, runs):
            value, n = runs.take()
            shard = roots.shard_of(_unturned(value))
            by_shard = np.argsort(shard, kind="stable")
            shard = shard[by_shard]
            value, n = value[by_shard], n[by_shard].astype("<u4")
            del by_shard
            bounds = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True])))
            cuts = list(zip(bounds, bounds[1:]))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(cuts), chunk)), pa.array(shard[bounds[:-1]]),
                 pa.array([_packed(value[a:b]) for a, b in cuts], pa.binary()),
                 pa.array([np.ascontiguousarray(n[a:b].view(np.uint8).reshape(-1, 4).T).tobytes()
                           for a, b in cuts], pa.binary())],
                ["chunk", "shard", "grams", "counts"])

        now, runs = None, _Runs()
        for chunk, batch in _by_chunk(batches, chunk_bytes):
            if chunk != now and now is not None:
                yield sent(now, runs)
                runs = _Runs()
                release_memory()
            now = chunk
            _distinct(runs, strings(batch.column("text")),
                      ~np.asarray(batch.column("held_out"), bool), order)
        if now is not None:
            yield sent(now, runs)
        release_memory()

    def answer(table: pa.Table) -> pa.Table:
        runs = _Runs()
        for grams, counts in zip(table.column("grams"), table.column("counts"), strict=True):
            n = np.frombuffer(counts.as_py(), np.uint8).reshape(4, -1).T
            runs.add(_unpacked(grams.as_py(), np.uint64),
                     np.ascontiguousarray(n).view("<u4").ravel().astype(np.int64))
        value, n = runs.take()
        gram = _unturned(value)
        trie = held.value.trie(gram[n > 0], n[n > 0], order)
        log10 = np.concatenate([trie.log10(gram[a:a + SCORE_CHUNK])
                                for a in range(0, len(gram), SCORE_CHUNK)])
        del trie, gram, runs, n
        out = [log10[np.searchsorted(value, _unpacked(x.as_py(), np.uint64))].tobytes()
               for x in table.column("grams")]
        release_memory()
        return pa.table({"chunk": table.column("chunk"), "grams": table.column("grams"),
                         "log10": pa.array(out, pa.binary())})

    sent = docs.select("held_out", "text").mapInArrow(
        pieces, "chunk long, shard int, grams binary, counts binary")
    return sent.groupBy("shard").applyInArrow(answer, "chunk long, grams binary, log10 binary")


def _chunk_scores(texts: pa.Array, answers: pa.Table, order: int) -> np.ndarray:
    """log10 probability of each text of a chunk."""
    parts = [_unpacked(x.as_py(), np.uint64) for x in answers.column("grams")]
    value = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    del parts
    sort = np.argsort(value, kind="stable")  # merges the shards' sorted runs
    value = value[sort]
    log10 = np.frombuffer(b"".join(x.as_buffer() for x in answers.column("log10")),
                          np.float64)[sort]
    del sort
    total = np.zeros(len(texts))
    for start, stop in byte_slices(texts):
        for gram, text in _grams(texts.slice(start, stop - start), order, SCORE_CHUNK):
            turned = _turned(gram)
            perm = np.argsort(turned)
            turned = turned[perm]
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(turned)), bool),
                                                   turned[1:] != turned[:-1])))
            own = turned[first]
            at = np.searchsorted(value, own)
            if len(own) and (at[-1] >= len(value) or (value[at] != own).any()):
                raise RuntimeError("the documents' scan gave other rows than before")
            logs = np.repeat(log10[at], np.diff(np.append(first, len(turned))))
            total += np.bincount(text[perm] + start, logs, len(texts))
    return total


def adaptive_log10(text: str, order: int = ORDER) -> float:
    """log10 probability of one text under a trie that learns as it reads (method D with
    symbol exclusion)."""
    data = bytes([END]) * order + text.encode() + bytes([END])
    counts: dict[bytes, dict[int, int]] = defaultdict(dict)
    total = 0.0
    for i in range(order, len(data)):
        excluded: set[int] = set()
        s = data[i]
        for k in range(order, -1, -1):
            node = counts[data[i - k:i]]
            live = {x: n for x, n in node.items() if x not in excluded}
            if live:
                whole = sum(live.values())
                total += math.log10((live[s] - DISCOUNT if s in live
                                     else DISCOUNT * len(live)) / whole)
                if s in live:
                    break
                excluded |= live.keys()
        else:
            total -= math.log10(256 - len(excluded))
        for k in range(order + 1):
            node = counts[data[i - k:i]]
            node[s] = node.get(s, 0) + 1
    return total


# --------------------------------------------------------------------- words ----
def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, word number of each token, text of each token)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    owner = np.repeat(np.arange(len(texts)), np.diff(np.asarray(lists.offsets)))
    coded = lists.flatten().dictionary_encode()
    number = np.asarray(coded.indices)
    real = np.asarray(pc.not_equal(coded.dictionary, ""), bool)[number]
    return coded.dictionary, number[real], owner[real]


def count_words(docs: DataFrame, where: Column) -> DataFrame:
    """(word, n) over the training texts; the empty word stands for the text's end."""
    def count(batches):
        held: list[pa.Table] = []
        for batch in batches:
            texts = strings(batch.column("text"))
            held.append(pa.table({"word": pa.array([""]), "n": pa.array([len(texts)])}))
            for pieces, _ in text_pieces(texts):
                words, number, _ = _words(pieces)
                n = np.bincount(number, minlength=len(words))
                at = np.flatnonzero(n)
                held.append(pa.table({"word": words.take(pa.array(at)).cast(pa.string()),
                                      "n": pa.array(n[at])}))
                if sum(map(len, held)) > PENDING:
                    yield from _summed(held)
                    held = []
            release_memory()
        yield from _summed(held)

    return docs.filter(where).select("text").mapInArrow(count, "word string, n long") \
        .groupBy("word").agg(F.sum("n").alias("n"))


def _rare_lists(parts: list[tuple[np.ndarray, pa.Array, np.ndarray]], n: int,
                name: str, kind: pa.DataType) -> pa.Array:
    """For each of ``n`` rows its list of (``name``, times)."""
    row = np.concatenate([r for r, _, _ in parts] or [np.zeros(0, np.int64)])
    order = np.argsort(row, kind="stable")
    values = pa.concat_arrays([w for _, w, _ in parts] or [pa.array([], kind)])
    times = np.concatenate([t for _, _, t in parts] or [np.zeros(0, np.int64)])
    pairs = pa.StructArray.from_arrays(
        [values.take(pa.array(order)), pa.array(times[order].astype(np.int32))],
        names=[name, "times"])
    bounds = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pairs)


def _summed(held: list[pa.Table]) -> list[pa.RecordBatch]:
    if not held:
        return []
    sums = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
    return sums.rename_columns({"n_sum": "n"}).select(["word", "n"]).to_batches()


def score(docs: DataFrame, learn: Column, order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row."""
    docs = docs.select("doc_id", "text", (~learn).alias("held_out"))
    where = ~F.col("held_out")
    roots = learn_roots(docs, where, order)
    words = stored(count_words(docs, where), "word-counts")
    n_all, n_distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    common = words.filter(F.col("n") * (1 << WORD_BITS) >= n_all)
    table = common.toArrow()  # at most 2**WORD_BITS rows
    held = docs.sparkSession.sparkContext.broadcast(
        (table.column("word").combine_chunks().cast(pa.large_string()),
         table.column("n").to_numpy()))
    bottom = n_all + 0.1 * (n_distinct + 1)
    kind = docs.schema["doc_id"].dataType.simpleString()
    chunk_bytes = CHUNK_BYTES

    def number(batches):
        for chunk, batch in _by_chunk(batches, chunk_bytes):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(batch.num_rows, chunk)), *batch.columns],
                ["chunk", *batch.schema.names])

    def measure(rows: pa.Table, answers: pa.Table) -> pa.Table:
        known, counts = held.value
        value = np.log10((np.append(counts, 0) + 0.1) / bottom)
        end = pc.index_in(pa.array([""], pa.large_string()), known).to_pylist()[0]
        texts = strings(rows.column("text").combine_chunks())
        n = len(texts)
        total = _chunk_scores(texts, answers, order)
        release_memory()
        tokens = np.ones(n, np.int64)
        in_table = np.full(n, 0 if end is None else 1, np.int64)
        base = np.full(n, value[-1 if end is None else end])
        rare: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        for pieces, owner in text_pieces(texts):
            names, word, text = _words(pieces)
            row = owner[text]
            tokens += np.bincount(row, minlength=n)
            at = np.asarray(pc.index_in(names, known).fill_null(-1))[word]
            hit = at >= 0
            in_table += np.bincount(row[hit], minlength=n)
            base += np.bincount(row[hit], value[at[hit]], n)
            pair, times = np.unique(row[~hit].astype(np.int64) * len(names) + word[~hit],
                                    return_counts=True)
            rare.append((pair // max(1, len(names)), names.take(pa.array(
                pair % max(1, len(names)))).cast(pa.string()), times))
        out = pa.table({
            "doc_id": rows.column("doc_id"), "held_out": rows.column("held_out"),
            "n_tokens": pa.array(tokens), "n_common": pa.array(in_table),
            "common_score": pa.array(base), "score": pa.array(total),
            "rare": _rare_lists(rare, n, "word", pa.string())})
        release_memory()
        return out

    numbered = docs.mapInArrow(
        number, f"chunk long, doc_id {kind}, text string, held_out boolean")
    scored = numbered.groupBy("chunk").cogroup(
        string_answers(docs, roots, order).groupBy("chunk")).applyInArrow(
        measure, f"doc_id {kind}, held_out boolean, n_tokens long, n_common long, "
        "common_score double, score double, rare array<struct<word:string,times:int>>")
    # written once, so the row numbers hold for both uses below
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()), "scored-texts")
    others = words.filter(F.col("n") * (1 << WORD_BITS) < n_all)
    rare = scored.select("row", F.inline("rare")).join(others, "word", "left")
    n = F.coalesce("n", F.lit(0))
    sums = rare.groupBy("row").agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("n_rare"),
        F.sum(F.col("times") * F.log10((n + F.lit(0.1)) / F.lit(bottom))).alias("rare_score"))
    return scored.drop("rare").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_common") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("common_score") + F.coalesce("rare_score", F.lit(0.0))).alias("base_score"),
        "score")
