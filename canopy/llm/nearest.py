"""Approximate nearest neighbours (5): a block matrix join with exact results.

Query rows are dealt to blocks of about ``QUERY_BLOCK`` rows by the hash of their number.
One block after the other is broadcast (its size is bounded) and meets all candidate rows in
one pass, tile by tile; its lists are written before the next block is read:

1. Vectors are quantised to int8 with one scale each.  A tile's inner products of
   int8 values are exact integers; scaled back they differ from the true ones by at
   most  |x| * |e_y| + |e_x| * |y_q|  (e: quantisation error, y_q: quantised vector).
2. A pair survives if its upper bound reaches the query's k-th best lower bound so far.
3. Surviving pairs are recomputed from the original vectors in double precision, and a
   heap for each query keeps the k best of the task.

The tasks' heaps are merged for each query.  Nothing is lost to the quantisation, so
recall is 1.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, and
rows with a null id, take no part; all rows of an id that repeats are candidates, and each of
them is a query of its own if the id is one, which leaves out its own row alone; a query meets
candidates of its own dimension only; ties go to the smaller id; fewer than k candidates give
them all; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.llm.common import stored

QUERY_BLOCK = 8_192
TILE = 4_096
QUERY_TILE = 1_024
SLACK = 1e-5  # relative, for the rounding of the bounds themselves


class _Quantised:
    """Vectors of one dimension with their int8 form and error figures."""

    def __init__(self, vectors: np.ndarray):
        x = np.ascontiguousarray(vectors, np.float64)
        self.x = x
        scale = np.abs(x).max(1) / 127
        self.q = np.rint(x / scale[:, None]).astype(np.int8)
        back = self.q * scale[:, None]
        self.scale = scale
        self.norm = np.linalg.norm(x, axis=1)
        self.q_norm = np.linalg.norm(back, axis=1)
        self.error = np.linalg.norm(x - back, axis=1)

    def rows(self, part) -> _Quantised:
        out = object.__new__(_Quantised)
        for name, value in vars(self).items():
            setattr(out, name, value[part])
        return out


def _tile(a: _Quantised, b: _Quantised) -> tuple[np.ndarray, np.ndarray]:
    """(approximate products, error bounds).  Up to 1024 products of int8 values sum
    exactly in float32; longer vectors are summed piece by piece in double."""
    width = a.q.shape[1]
    product = np.zeros((len(a.q), len(b.q)))
    for d in range(0, width, 1024):
        product += a.q[:, d:d + 1024].astype(np.float32) @ b.q[:, d:d + 1024].astype(
            np.float32).T
    product *= a.scale[:, None] * b.scale[None, :]
    bound = a.norm[:, None] * b.error[None, :] + a.error[:, None] * b.q_norm[None, :]
    return product, bound + SLACK * a.norm[:, None] * b.norm[None, :] + 1e-300


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in component order."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


class _Best:
    """Heaps of the k best (score, -id) of each query; the k-th score is its threshold."""

    def __init__(self, rows: np.ndarray, queries: _Quantised, k: int):
        self.rows, self.queries, self.k = rows, queries, k
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in rows]
        self.least = np.full(len(rows), -np.inf)

    def meet(self, numbers: np.ndarray, ids: np.ndarray, rows: _Quantised) -> None:
        for start in range(0, len(self.rows), QUERY_TILE):
            part = slice(start, start + QUERY_TILE)
            product, bound = _tile(self.queries.rows(part), rows)
            own = self.rows[part][:, None] == numbers[None, :]
            product[own] = -np.inf
            lower = product - bound
            least = self.least[part]
            if lower.shape[1] > self.k:
                kth = lower.shape[1] - self.k
                least = np.maximum(least, np.partition(lower, kth, axis=1)[:, kth])
            q, c = np.nonzero((product + bound >= least[:, None]) & ~own)
            for at in range(0, len(q), 1 << 16):
                qq, cc = q[at:at + (1 << 16)] + start, c[at:at + (1 << 16)]
                score = _exact(self.queries.x[qq], rows.x[cc])
                for query, s, other in zip(qq.tolist(), score.tolist(),
                                           (-ids[cc]).tolist(), strict=True):
                    heap = self.heaps[query]
                    if len(heap) < self.k:
                        heapq.heappush(heap, (s, other))
                    elif (s, other) > heap[0]:
                        heapq.heapreplace(heap, (s, other))
            for query in np.unique(q) + start:
                if len(self.heaps[query]) == self.k:
                    self.least[query] = self.heaps[query][0][0]


def clean(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(row, vec_id, embedding) of the rows that take part; stored, so row numbers stay."""
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                  & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    some = F.exists("embedding", lambda x: x != 0)
    kept = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding")) \
        .filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(ok & some)
    return stored(kept.withColumn("row", F.monotonically_increasing_id()), "vectors")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products."""
    rows = clean(vectors, id_col, vector_col)
    queries = rows.filter(is_query)
    n_blocks = queries.count() // QUERY_BLOCK + 1
    lists = []
    for block in range(n_blocks):
        part = queries.filter(F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == block).toArrow()
        lists.append(_block_join(rows, part, k))
    found = lists[0]
    for more in lists[1:]:
        found = found.union(more)
    # the limit on the rank reaches the map side of this window
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


def _by_dimension(table) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(dimension, rows, ids, vectors) of a table or batch of vectors."""
    column = table.column("embedding")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    numbers, ids = (table.column(c).to_numpy() for c in ("row", "vec_id"))
    sizes = np.asarray(column.value_lengths())
    out = []
    for width in np.unique(sizes):
        at = np.flatnonzero(sizes == width)
        flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        out.append((int(width), numbers[at], ids[at], flat.reshape(len(at), int(width))))
    return out


def _block_join(rows: DataFrame, part: pa.Table, k: int) -> DataFrame:
    """(query, query_id, vec_id, score) of the tasks' heaps for one block; stored."""
    held = rows.sparkSession.sparkContext.broadcast(
        {w: (n, i, v) for w, n, i, v in _by_dimension(part.sort_by("row"))} if len(part) else {})

    def join(batches):
        best = {w: _Best(n, _Quantised(v), k) for w, (n, _, v) in held.value.items()}
        for batch in batches:
            for start in range(0, batch.num_rows, TILE):
                for width, n, i, v in _by_dimension(batch.slice(start, TILE)):
                    if width in best:
                        best[width].meet(n, i, _Quantised(v))
        out = [(int(n), int(q), -other, s) for w, b in best.items()
               for n, q, heap in zip(b.rows, held.value[w][1], b.heaps, strict=True)
               for s, other in heap]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[c] for x in out], pa.float64() if c == 3 else pa.int64())
             for c in range(4)], ["query", "query_id", "vec_id", "score"])

    found = stored(rows.mapInArrow(join, "query long, query_id long, vec_id long, score double"),
                   "nearest-lists")
    held.unpersist()
    return found
