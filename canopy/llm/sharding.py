"""Sharding (7): best-fit-decreasing packing of indivisible groups.

Rows of equal text form a group; a group's size is the sum of its rows' sizes.  Groups
in descending size enter the bin with the tightest remaining capacity that still holds
them, found in a balanced tree.  Groups of one size are interchangeable, and a bin that
was the tightest stays so while it takes more of the same size, so the plan is made per
size: (first rank, bin) runs over all groups in descending order.  The driver sees the
histogram of group sizes alone; it has at most sqrt(2 * total bytes) rows, as distinct
sizes add up to no more than the total.

With ``shards`` given, the capacity is an even share of the bytes.  A group above the
even share gets a shard of its own and the others share what is left.  A group that no
bin can hold any more (by then only the smallest are left) goes to the emptiest bin.
With ``capacity`` given, bins are opened as needed, as few as best fit needs.

Ranks and slots are numbered in two levels (inside a stored part, then over the parts'
counts), so neither a hot group nor a hot shard has to fit into one task.

Defined cases: null text counts as empty (size 16, crc32 of no bytes) and shares the
group of the empty text; null doc_ids stay; repeated rows are separate rows of one
group; equal sizes go by the texts' hashes; further columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopy.llm.common import stored

ROW_BYTES = 16


class Node:
    """A node of the balanced tree (a treap): keys are (remaining capacity, bin)."""

    __slots__ = ("key", "heat", "left", "right")

    def __init__(self, key: tuple[int, int]):
        self.key = key
        # a fixed scramble of the bin number keeps the depth logarithmic
        self.heat = (key[1] * 0x9E3779B97F4A7C15 + 0x7F4A7C15) >> 7 & 0xFFFFFFFF
        self.left = self.right = None


def _split(node, key):
    """(keys below ``key``, the others)."""
    if node is None:
        return None, None
    if node.key < key:
        node.right, high = _split(node.right, key)
        return node, high
    low, node.left = _split(node.left, key)
    return low, node


def _merge(low, high):
    if low is None or high is None:
        return low or high
    if low.heat > high.heat:
        low.right = _merge(low.right, high)
        return low
    high.left = _merge(low, high.left)
    return high


class Bins:
    """Open bins by remaining capacity."""

    def __init__(self):
        self.root = None

    def add(self, room: int, name: int) -> None:
        low, high = _split(self.root, (room, name))
        self.root = _merge(_merge(low, Node((room, name))), high)

    def remove(self, room: int, name: int) -> None:
        low, rest = _split(self.root, (room, name))
        _, high = _split(rest, (room, name + 1))
        self.root = _merge(low, high)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The least remaining capacity that is at least ``size``."""
        node, best = self.root, None
        while node is not None:
            if node.key >= (size, -1):
                best, node = node.key, node.left
            else:
                node = node.right
        return best

    def emptiest(self) -> tuple[int, int]:
        node = self.root
        while node.right is not None:
            node = node.right
        return node.key


def plan(sizes: np.ndarray, counts: np.ndarray, shards: int | None = None,
         capacity: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first rank, bin) of each run; ranks number the groups by descending size."""
    order = np.argsort(-sizes, kind="stable")
    sizes, counts = sizes[order].tolist(), counts[order].tolist()
    bins, starts, names = Bins(), [], []
    rank = opened = 0
    if shards is not None:
        left, total = shards, sum(s * n for s, n in zip(sizes, counts, strict=True))
        rest = []
        for s, n in zip(sizes, counts, strict=True):
            while n and left > 1 and s * left > total:  # above the even share of what is left
                starts.append(rank)
                names.append(opened)
                rank, opened, left, total, n = rank + 1, opened + 1, left - 1, total - s, n - 1
            rest.append((s, n))
        capacity = -(-total // left)
        for name in range(opened, shards):
            bins.add(capacity, name)
    else:
        rest = list(zip(sizes, counts, strict=True))
    for s, n in rest:
        while n:
            found = bins.tightest(s)
            if found is None and shards is None:
                found = (max(capacity, s), opened)
                bins.add(*found)
                opened += 1
            if found is None:
                found = bins.emptiest()
                take = 1
            else:
                take = min(n, found[0] // s) if s else n
            bins.remove(*found)
            bins.add(found[0] - take * s, found[1])
            starts.append(rank)
            names.append(found[1])
            rank, n = rank + take, n - take
    return np.asarray(starts, np.int64), np.asarray(names, np.int64)


def _numbered(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Number stored rows from 0 within ``by``: inside each part first, then over the parts.

    ``rows`` must be read from files and hold ``part`` and ``at`` (order inside the part).
    """
    counts = rows.groupBy(*by, "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    offsets = counts.select(*by, "part", (F.sum("n").over(before) - F.col("n")).alias("base"))
    inside = Window.partitionBy(*by, "part").orderBy("at")
    return rows.withColumn("inside", F.row_number().over(inside) - 1) \
        .join(offsets, [*by, "part"]) \
        .withColumn(name, F.col("base") + F.col("inside")).drop("base", "inside", "part", "at")


def shard(docs: DataFrame, shards: int | None = None, capacity: int | None = None
          ) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each row."""
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    text = F.coalesce("text", F.lit(""))
    rows = stored(docs.select(
        "doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit("second"), text).alias("h2")), "shard-rows")
    groups = rows.groupBy("size", "h1", "h2").agg(
        (F.sum("size")).alias("bytes"), F.count("*").alias("n"))
    # descending sizes over the parts: rank = part's offset + place in the part
    ordered = stored(groups.repartitionByRange(F.col("bytes").desc(), "h1", "h2")
                     .sortWithinPartitions(F.col("bytes").desc(), "h1", "h2")
                     .withColumn("part", F.spark_partition_id())
                     .withColumn("at", F.monotonically_increasing_id()), "shard-groups")
    histogram = ordered.groupBy("bytes").agg(F.count("*").alias("n")).toArrow()
    starts, names = plan(histogram.column("bytes").to_numpy(), histogram.column("n").to_numpy(),
                         shards, capacity)
    parts = ordered.groupBy("part").agg(F.count("*").alias("n")).toArrow()
    number = np.argsort(parts.column("part").to_numpy())
    size = parts.column("n").to_numpy()[number]
    base = dict(zip(parts.column("part").to_numpy()[number].tolist(),
                    (np.cumsum(size) - size).tolist(), strict=True))
    held = docs.sparkSession.sparkContext.broadcast((base, starts, names))

    def place(batches):
        base, starts, names = held.value
        for batch in batches:
            part = batch.column("part").to_pylist()
            at = batch.column("at").to_numpy() & ((1 << 33) - 1)
            rank = at + np.asarray([base[p] for p in part], np.int64)
            shard = names[np.searchsorted(starts, rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("size", "h1", "h2")] + [pa.array(shard)],
                ["size", "h1", "h2", "shard"])

    placed = ordered.select("size", "h1", "h2", "part", "at").mapInArrow(
        place, "size long, h1 long, h2 long, shard long")
    out = stored(rows.join(placed, ["size", "h1", "h2"]).select(
        "doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"),
        F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")),
        "shard-placed")
    return _numbered(out, ["shard"], "slot")
