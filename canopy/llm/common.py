"""Helpers shared by the training-data operators.

Texts reach Python as Arrow string arrays.  ``utf8_parts`` gives their bytes as
one numpy view, ``byte_slices`` cuts a batch into runs of rows of bounded size,
and ``cut_long`` splits long texts at ASCII white space so that no later step
holds more than about ``limit`` bytes at a time.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.session import discard, ensure_checkpoint_dir, stored  # noqa: F401

SLICE_BYTES = 2_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % divisor


def hash_share(column: Column, share: float) -> Column:
    """True for about ``share`` of the values, chosen by their hash."""
    return F.pmod(F.xxhash64(column), F.lit(1 << 20)) < F.lit(round(share * (1 << 20)))


def join_side(df: DataFrame, few: bool) -> DataFrame:
    """``df`` as a side of a join: broadcast if it has few rows, else joined by shuffle.

    ``few`` comes from a count or a bound.  Spark's own choice goes by the size of files, which
    compressed or exploded rows exceed many times over."""
    return F.broadcast(df) if few else df.hint("merge")


def strings(column: pa.Array) -> pa.Array:
    """Column of a batch as a 64-bit-offset string array without nulls (null becomes '')."""
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def utf8_parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a ``strings`` array; offsets start at 0."""
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if data is None:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]], off - off[0]


def byte_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges (start, stop) of at most ``limit`` bytes, or one row that is longer."""
    _, off = utf8_parts(texts)
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(off, off[start] + limit, side="right")) - 1
        stop = max(stop, start + 1)
        yield start, stop
        start = stop


_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def cut_long(texts: pa.Array, limit: int = SLICE_BYTES) -> tuple[pa.Array, np.ndarray]:
    """Cut texts over ``limit`` bytes after ASCII white space; (pieces, row of each piece).

    A stretch without white space is never cut, however long it is.
    """
    data, off = utf8_parts(texts)
    lengths = np.diff(off)
    if not len(texts) or lengths.max() <= limit:
        return texts, np.arange(len(texts))
    bounds, rows = [0], []
    for row in range(len(texts)):
        at, end = int(off[row]), int(off[row + 1])
        while end - at > limit:
            back = np.flatnonzero(_WHITE[data[at:at + limit]])
            if len(back):
                cut = at + int(back[-1]) + 1
            else:
                cut = at + limit
                while cut < end and not _WHITE[data[cut - 1]]:
                    ahead = np.flatnonzero(_WHITE[data[cut:min(end, cut + limit)]])
                    cut = cut + int(ahead[0]) + 1 if len(ahead) else min(end, cut + limit)
            bounds.append(cut)
            rows.append(row)
            at = cut
        bounds.append(end)
        rows.append(row)
    pieces = pa.LargeStringArray.from_buffers(
        len(rows), pa.py_buffer(np.asarray(bounds, np.int64)), pa.py_buffer(data.tobytes()))
    return pieces, np.asarray(rows)


def text_pieces(texts: pa.Array, limit: int = SLICE_BYTES
                ) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Pieces of bounded size with the row each belongs to, in text order."""
    pieces, rows = cut_long(texts, limit)
    for start, stop in byte_slices(pieces, limit):
        yield pieces.slice(start, stop - start), rows[start:stop]


def release_memory() -> None:
    """Give freed memory back to the system: workers live on, and with them what earlier
    tasks' work arrays have left in the allocators."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
