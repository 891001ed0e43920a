"""Packing (10): cost-balanced training sequences without padding.

A document is its token ids and one closing id.  Whole multiples of the capacity leave a long
document as full sequences of their own.  The rests are packed in two steps:

1. Inside a task, runs of documents (``RUN_BYTES`` of text, whatever the Arrow batches): the
   rests, T tokens together, fill T // capacity sequences.  The T % capacity tokens left over,
   those of the shortest rests, are passed on.
2. What all runs pass on is dealt to groups of about ``GROUP_TOKENS`` tokens by row number and
   packed there.  Only a group's last T % capacity tokens go into short sequences, whose
   lengths are the powers of two of that number.

In both steps rests are taken in descending length; each enters the sequence of lowest cost
(linear plus quadratic attention cost of its pieces) that has room for all of it.  A rest that
fits nowhere is cut at the room of the cheapest open sequence.

A run passes on fewer than ``capacity`` tokens, so the second step shuffles little unless
partitions are tiny; then it does the packing.  Sequence ids hold the task's partition or the
group and a counter.

Defined cases: a null text is empty and gives the closing id alone; a null doc_id
stays null; each input row is packed on its own, repeated rows too; ties in length
go by position; further columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
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
from canopy.llm.words import encoder

RUN_BYTES = 2 * SLICE_BYTES
GROUP_TOKENS = 1 << 20
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048


def plan(lengths: list[int], capacity: int, linear: float = LINEAR,
         quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (row, start, length, sequence, offset) that use up all tokens."""
    pieces: list[tuple[int, int, int, int, int]] = []
    count = 0
    rests: list[tuple[int, int]] = []
    for row, n in enumerate(lengths):
        for k in range(n // capacity):
            pieces.append((row, k * capacity, capacity, count, 0))
            count += 1
        if n % capacity:
            rests.append((n % capacity, row))
    total = sum(n for n, _ in rests)
    rooms = [capacity] * (total // capacity)
    rooms += [1 << b for b in range(capacity.bit_length() - 1, -1, -1)
              if total % capacity >> b & 1]
    first, used = count, [0] * len(rooms)
    by_cost = [(0.0, s) for s in range(len(rooms))]  # one entry for each open sequence
    for rest, row in sorted(rests, key=lambda x: (-x[0], x[1])):
        start = lengths[row] - rest
        while rest:
            passed = []
            while by_cost and rooms[by_cost[0][1]] - used[by_cost[0][1]] < rest:
                passed.append(heapq.heappop(by_cost))
            cost, s = heapq.heappop(by_cost) if by_cost else passed.pop(0)
            n = min(rest, rooms[s] - used[s])
            pieces.append((row, start, n, first + s, used[s]))
            used[s] += n
            start, rest = start + n, rest - n
            for entry in passed:
                heapq.heappush(by_cost, entry)
            if used[s] < rooms[s]:
                heapq.heappush(by_cost, (cost + linear * n + quadratic * n * n, s))
    return pieces


def set_aside(lengths: list[int], capacity: int) -> list[int]:
    """Tokens that each document passes on, from its end: of the shortest rests, as many as
    all rests together have above a multiple of the capacity."""
    rests = sorted((n % capacity, row) for row, n in enumerate(lengths) if n % capacity)
    spare = sum(n for n, _ in rests) % capacity
    out = [0] * len(lengths)
    for n, row in rests:
        out[row] = min(n, spare)
        spare -= out[row]
        if not spare:
            break
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(doc ids, texts) of consecutive rows of about ``RUN_BYTES``."""
    ids, texts, held = [], [], 0
    for batch in batches:
        whole = strings(batch.column("text"))
        for start, stop in byte_slices(whole, RUN_BYTES):
            part = whole.slice(start, stop - start)
            size = len(utf8_parts(part)[0])
            if held and held + size > RUN_BYTES:
                yield pa.concat_arrays(ids), pa.concat_arrays(texts)
                ids, texts, held = [], [], 0
            ids.append(batch.column("doc_id").slice(start, stop - start))
            texts.append(part)
            held += size
    if ids:
        yield pa.concat_arrays(ids), pa.concat_arrays(texts)


def _piece_columns(doc_id: pa.Array, starts: np.ndarray, tokens: np.ndarray,
                   parts: list[np.ndarray], sequence: np.ndarray, offset: np.ndarray) -> dict:
    return {
        "doc_id": doc_id, "start": pa.array(starts, pa.int64()),
        "length": pa.array([len(x) for x in parts], pa.int64()),
        "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in parts], pa.int64()),
        "doc_tokens": pa.array(tokens, pa.int64()),
        "sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64())}


def _ids_column(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([x.astype(np.int32) for x in parts], pa.list_(pa.int32()))


def pack(docs: DataFrame, tokenizer_json: str, capacity: int = 2048, closing_id: int = 1,
         with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece; ``with_ids`` adds the piece's token ids (array<int>)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    vocabulary = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
              "sequence_id long, offset long")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary.value)
        next_id = TaskContext.get().partitionId() << 36
        for doc_id, texts in _runs(batches):
            ids = _document_ids(encode, texts, closing_id)
            lengths = [len(x) for x in ids]
            passed = set_aside(lengths, capacity)
            placed = plan([n - k for n, k in zip(lengths, passed, strict=True)], capacity)
            loose = [(r, lengths[r] - k, k, 0, 0) for r, k in enumerate(passed) if k]
            row, begin, _, sequence, offset = np.asarray(placed + loose, np.int64).T
            parts = [ids[r][b:b + n] for r, b, n, _, _ in placed + loose]
            columns = _piece_columns(doc_id.take(pa.array(row)), begin,
                                     np.asarray(lengths, np.int64)[row], parts,
                                     sequence + next_id, offset)
            keep = [None] * len(placed) if not with_ids else parts[:len(placed)]
            columns["ids"] = pa.array([None if x is None else x.astype(np.int32) for x in
                                       keep + parts[len(placed):]], pa.list_(pa.int32()))
            columns["loose"] = pa.array([False] * len(placed) + [True] * len(loose))
            next_id += len(placed)
            yield pa.RecordBatch.from_pydict(columns)
            release_memory()

    def gather(table: pa.Table) -> pa.Table:
        ids = [np.asarray(x.values) for x in table.column("ids")]
        placed = plan([len(x) for x in ids], capacity)
        row, begin, _, sequence, offset = np.asarray(placed, np.int64).T
        parts = [ids[r][b:b + n] for r, b, n, _, _ in placed]
        group = table.column("group")[0].as_py()
        columns = _piece_columns(
            table.column("doc_id").combine_chunks().take(pa.array(row)),
            table.column("start").to_numpy()[row] + begin,
            table.column("doc_tokens").to_numpy()[row], parts,
            sequence + (1 << 60 | group << 24), offset)
        if with_ids:
            columns["ids"] = _ids_column(parts)
        return pa.table(columns)

    first = stored(rows.mapInArrow(pieces, schema + ", ids array<int>, loose boolean")
                   .withColumn("number", F.monotonically_increasing_id()), "packed")
    names = [c.split()[0] for c in schema.split(", ")] + ["ids"] * with_ids
    loose = first.filter("loose")
    groups = (loose.agg(F.sum("length")).first()[0] or 0) // GROUP_TOKENS + 1
    gathered = loose.withColumn("group", F.pmod("number", F.lit(groups))).groupBy("group") \
        .applyInArrow(gather, schema + ", ids array<int>" * with_ids)
    return first.filter("NOT loose").select(*names).unionByName(gathered)


def _document_ids(encode, texts: pa.Array, closing_id: int) -> list[np.ndarray]:
    """Token ids of each text with the closing id."""
    parts: list[list[np.ndarray]] = [[] for _ in range(len(texts))]
    for cut, rows in text_pieces(texts, 2 * SLICE_BYTES):
        ids, bounds = encode.encode(cut)
        for k, row in enumerate(rows):
            parts[row].append(ids[bounds[k]:bounds[k + 1]])
    end = np.asarray([closing_id], np.uint32)
    return [np.concatenate([*x, end]) for x in parts]
