"""Vector code compression (12): product codes with memoised grid cells.

A vector's components become integers floor(1024 * x) and the vector is cut into ``PARTS``
consecutive parts.  Each part position has a codebook of up to ``ENTRIES`` entries, which a few
rounds of assignment and averaging improve; a vector's code is the nearest entry of each part.

Finding the nearest entry: a part falls into a coarse grid cell.  For a cell, the smallest and
largest distance of every entry to any point of its box are computed once; an entry whose
smallest distance exceeds another's largest is never nearest inside the box.  The others are
kept in a memo under the cell's hash (with the cell itself, so equal hashes are told apart), and
only these are evaluated exactly, in integers.  The memo belongs to one task and one codebook,
is emptied at ``MEMO_CELLS`` cells and changes no result.  The cell side follows the codebook's
own scale (``_side``).

Each round is one pass over the stored integer vectors: tasks add up parts for each entry, the
sums (at most ENTRIES * dimension numbers) are added by Spark, and only they reach the driver.

Defined cases: null and empty vectors and those with null or non-finite components take no
part, nor do vectors of another dimension than that of the smallest vec_id; where the dimension
is no multiple of ``PARTS``, parts differ by one component; components are held to
+-``LIMIT`` / 1024, so sums of squares stay within 64 bits; rows of one vec_id are all kept,
ordered by their vectors (a null vec_id last), and each may start an entry; fewer than
``ENTRIES`` rows give fewer entries; null labels count together; further columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import release_memory, stored

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
LIMIT = 1 << 24
MEMO_CELLS = 1 << 15
PAIRS = 1 << 17  # (vector, entry) pairs or (cell, entry) pairs evaluated at once


# -------------------------------------------------------------------- codebook ----
def _side(entries: np.ndarray) -> int:
    """Cell side: the power of two next below a quarter of the root mean square component
    distance of two entries."""
    spread = np.sqrt(2 * entries.astype(np.float64).var(axis=0).mean()) if entries.size else 0.0
    return 1 << max(0, int(np.floor(np.log2(max(spread / 4, 1.0)))))


def _exact(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of paired rows, in integers."""
    total = np.zeros(len(x), np.int64)
    for d in range(x.shape[1]):
        step = x[:, d] - entries[:, d]
        total += step * step
    return total


class Codebook:
    """Entries of one part position, and the memo of grid cells."""

    def __init__(self, entries: np.ndarray):
        self.entries = np.ascontiguousarray(entries, np.int64)
        self.shift = _side(self.entries).bit_length() - 1
        self.mix = np.random.default_rng(7).integers(
            1, 1 << 62, entries.shape[1], np.int64) * 2 + 1
        self.memo: dict[int, tuple[bytes, np.ndarray]] = {}
        self.evaluated = 0

    def _candidates(self, cells: np.ndarray) -> list[np.ndarray]:
        """For each cell the entries that are nearest to some point of its box, or may be."""
        out = []
        step = max(1, PAIRS // max(1, len(self.entries)))
        for at in range(0, len(cells), step):
            low = cells[at:at + step] << self.shift
            high = low + (1 << self.shift) - 1  # integers of the box only
            least = np.zeros((len(low), len(self.entries)), np.int64)
            most = np.zeros_like(least)
            for d in range(cells.shape[1]):
                below = low[:, d, None] - self.entries[None, :, d]
                above = self.entries[None, :, d] - high[:, d, None]
                near = np.maximum(np.maximum(below, above), 0)
                far = np.maximum(np.abs(below), np.abs(above))
                least += near * near
                most += far * far
            alive = least <= most.min(axis=1)[:, None]
            out.extend(np.flatnonzero(x) for x in alive)
        return out

    def _lookup(self, cells: np.ndarray) -> list[np.ndarray]:
        """Candidates of distinct cells, from the memo where it has them."""
        hashes = (cells * self.mix).sum(axis=1).tolist()
        raw = [x.tobytes() for x in cells]
        held = [self.memo.get(h) for h in hashes]
        missing = [k for k, x in enumerate(held) if x is None or x[0] != raw[k]]
        fresh = dict(zip(missing, self._candidates(cells[missing]), strict=True))
        if len(self.memo) + len(fresh) > MEMO_CELLS:
            self.memo.clear()
        for k, found in fresh.items():
            if len(self.memo) < MEMO_CELLS:
                self.memo[hashes[k]] = (raw[k], found)
        return [fresh[k] if k in fresh else held[k][1] for k in range(len(cells))]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row; ties to the lower entry."""
        code, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        if not len(x) or not x.shape[1]:
            return code, error
        cells, of = np.unique(x >> self.shift, axis=0, return_inverse=True)
        lists = self._lookup(cells)
        sizes = np.asarray([len(y) for y in lists])
        flat, first = np.concatenate(lists), np.cumsum(sizes) - sizes
        bounds = np.concatenate(([0], np.cumsum(sizes[of])))
        at = 0
        while at < len(x):
            stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + PAIRS, "right")) - 1)
            own = of[at:stop]
            starts = np.cumsum(sizes[own]) - sizes[own]
            row = np.repeat(np.arange(stop - at), sizes[own])
            entry = flat[np.arange(len(row)) - starts[row] + first[own][row]]
            distance = _exact(x[at:stop][row], self.entries[entry])
            self.evaluated += len(row)
            least = np.minimum.reduceat(distance, starts)
            tied = np.flatnonzero(distance == least[row])
            code[at:stop] = entry[tied[np.searchsorted(row[tied], np.arange(stop - at))]]
            error[at:stop] = least
            at = stop
        return code, error


def cuts(dimension: int, parts: int = PARTS) -> list[int]:
    return [dimension * k // parts for k in range(parts + 1)]


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(
        len(column), dimension)


# ------------------------------------------------------------------------ jobs ----
def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v array<long>) of the rows that take part, whatever their dimension."""
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                  & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    whole = F.transform("embedding", lambda x: F.greatest(F.lit(-LIMIT), F.least(
        F.lit(LIMIT), F.floor(x.cast("double") * SCALE))).cast("long"))
    return vectors.filter(F.col("embedding").isNotNull()).filter(ok & (F.size("embedding") > 0)) \
        .select("vec_id", "label", whole.alias("v"))


def train(rows: DataFrame, dimension: int, entries: int = ENTRIES, rounds: int = ROUNDS
          ) -> list[np.ndarray]:
    """Codebooks, one for each part; ``rows`` are stored integer vectors of one dimension."""
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries) \
        .select("v").toArrow().column("v").combine_chunks()
    at = cuts(dimension)
    first = _matrix(seeds, dimension)
    books = [first[:, a:b].copy() for a, b in zip(at, at[1:])]
    for _ in range(rounds):
        for part, entry, n, sums in _sums(rows, books, dimension):
            books[part][entry] = np.floor_divide(sums, n)
    return books


def _sums(rows: DataFrame, books: list[np.ndarray], dimension: int):
    """(part, entry, number of parts, their sums) of the entries in use."""
    at = cuts(dimension)
    width = max(b - a for a, b in zip(at, at[1:]))
    held = rows.sparkSession.sparkContext.broadcast(books)

    def add(batches):
        finders = [Codebook(b) for b in held.value]
        n = np.zeros((len(finders), len(held.value[0])), np.int64)
        total = np.zeros((*n.shape, width), np.int64)
        for batch in batches:
            v = _matrix(batch.column("v"), dimension)
            for part, (finder, a, b) in enumerate(zip(finders, at, at[1:])):
                code, _ = finder.nearest(v[:, a:b])
                n[part] += np.bincount(code, minlength=n.shape[1])
                np.add.at(total[part], (code, slice(0, b - a)), v[:, a:b])
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(entry), pa.array(n[part, entry])]
            + [pa.array(total[part, entry, d]) for d in range(width)],
            ["part", "entry", "n", *(f"s{d}" for d in range(width))])
        release_memory()

    names = [f"s{d}" for d in range(width)]
    out = rows.select("v").mapInArrow(
        add, "part long, entry long, n long, " + ", ".join(f"{c} long" for c in names)) \
        .groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in ("n", *names))).toArrow()
    held.unpersist()
    sums = np.asarray([out.column(c).to_numpy() for c in names]).T.reshape(-1, width)
    for k, (part, entry, n) in enumerate(zip(*(out.column(c).to_pylist()
                                              for c in ("part", "entry", "n")), strict=True)):
        yield part, entry, n, sums[k, :at[part + 1] - at[part]]


def assign(rows: DataFrame, books: list[np.ndarray], dimension: int) -> DataFrame:
    """(vec_id, label, codes array<int>, error)."""
    at = cuts(dimension)
    held = rows.sparkSession.sparkContext.broadcast(books)

    def code(batches):
        finders = [Codebook(b) for b in held.value]
        for batch in batches:
            v = _matrix(batch.column("v"), dimension)
            found = [f.nearest(v[:, a:b]) for f, a, b in zip(finders, at, at[1:])]
            codes = np.stack([c for c, _ in found], axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"),
                 pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel()), codes.shape[1])
                 .cast(pa.list_(pa.int32())),
                 pa.array(sum(e for _, e in found))], ["vec_id", "label", "codes", "error"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return rows.mapInArrow(code, f"vec_id {kinds['vec_id']}, label {kinds['label']}, "
                                 "codes array<int>, error long")


def encode(vectors: DataFrame) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, codes, error, label_error) of the rows that take part, codebooks)."""
    rows = integers(vectors)
    smallest = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(
        F.size("v").alias("d")).first()
    dimension = smallest.d if smallest else PARTS
    rows = stored(rows.filter(F.size("v") == dimension), "vector-integers")
    books = train(rows, dimension)
    coded = stored(assign(rows, books, dimension), "vector-codes")
    sums = coded.groupBy(F.col("label").alias("of_label")).agg(
        F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of_label"))).drop("of_label"), books


def fingerprint(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist())
                          .encode()).hexdigest()


def hex_code(codes: str) -> Column:
    """The codes of a row as two lowercase hex digits each."""
    return F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
