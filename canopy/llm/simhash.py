"""SimHash near-dedup (4): deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments, so that of two fingerprints within
three bits one segment differs by at most one bit.  Each segment is indexed whole and
under its one-wildcard variants (one bit left out, 32 for each segment).  Fingerprints
that share a variant are candidates; a wildcard variant pairs only those that differ
at the wildcard, so a pair is not found again under every variant.  Candidates are
verified by their distance.

Work is over distinct fingerprints.  A bucket (one variant's equal value) with more
than ``SPLIT`` members is not paired: its members are keyed again by the bits that the
bucket leaves open, cut in two in the same way, and so on while buckets are large.  By
the pigeonhole rule each level keeps every pair, and each level halves the open bits,
so the last buckets are small by construction.

Components: large-star and small-star rounds over the links, each round written to the
shared folder, until nothing changes.

Defined cases: null text counts as empty and has fingerprint zero, linked like any
other; a null doc_id stays and never names a component (a component without any id is
null); repeated rows share fingerprint and component; further columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from canopy.llm.common import (
    byte_slices,
    join_side,
    release_memory,
    stored,
    strings,
    utf8_parts,
)

SHINGLE = 3
MAX_BITS = 3
SEED = 42
STEP = 200_000  # shingles unpacked at a time
SPLIT = 512  # bucket size above which members are keyed again
#: Up to this many rows of a few longs (some 30 MB) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 100_000
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Bit table: the 8 bits of each byte value, lowest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little") \
    .astype(np.int64)


def fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprint of each text as uint64."""
    out = np.zeros(len(texts), np.uint64)
    for start, stop in byte_slices(texts):
        data, off = utf8_parts(pc.ascii_lower(texts.slice(start, stop - start)))
        for k in range(stop - start):
            out[start + k] = _fingerprint(data[off[k]:off[k + 1]], shingle)
    return out


def _fingerprint(data: np.ndarray, shingle: int) -> int:
    words = data.tobytes().split()  # bytes split at exactly these six ASCII characters
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin = (end - size).tolist()
    end = end.tolist()
    n = max(1, len(words) - shingle + 1)
    last = min(shingle, len(words)) - 1
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for a in range(0, n, STEP):
        b = min(n, a + STEP)
        h = np.fromiter((digest(joined[x:y], SEED) for x, y in
                         zip(begin[a:b], end[a + last:b + last], strict=True)), np.uint64, b - a)
        lanes = h.view(np.uint8).reshape(-1, 8)
        total += (np.stack([np.bincount(lanes[:, k], minlength=256) for k in range(8)])
                  @ _BITS).ravel()
    bits = np.packbits(2 * total > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of each row; ``fp`` is the fingerprint as a signed long."""
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            fp = fingerprints(strings(batch.column("text")), shingle)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])
            release_memory()

    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


# ---------------------------------------------------------------------- links ----
def _rekey(rows: DataFrame, max_bits: int) -> DataFrame:
    """Variants of each member: a half of its open bits held equal, whole or but for one
    wildcard bit.

    A bucket is (fixed, wild, key): the bits that are equal, those that must differ, and
    the equal bits' values.  Open bits are the ``width`` bits from ``low``.
    """
    half = "width / 2"
    at = f"int(low + h * {half})"
    bit = f"if(v < {half}, shiftleft(1L, int({at} + v)), 0L)"
    block = f"shiftleft(shiftleft(1L, int({half})) - 1L, {at})"
    return rows.withColumn("h", F.explode(F.array(F.lit(0), F.lit(1)))) \
        .withColumn("v", F.explode(F.expr(f"sequence(0, int({half}))"))) \
        .select("fp", F.expr(f"int(low + (1 - h) * {half})").alias("low"),
                F.expr(f"int({half})").alias("width"),
                F.expr(f"fixed | ({block} & ~{bit})").alias("fixed"),
                F.expr(f"wild | {bit}").alias("wild")) \
        .filter(F.bit_count("wild") <= max_bits) \
        .withColumn("key", F.col("fp").bitwiseAND(F.col("fixed")))


BUCKET = ["fixed", "wild", "key"]


def link_pairs(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints within ``max_bits`` bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments hold pairs of up to three differing bits")
    zero = F.lit(0).cast("long")
    level = fps.select("fp", F.lit(0).alias("low"), F.lit(64).alias("width"),
                       zero.alias("fixed"), zero.alias("wild"))
    found = []
    while True:
        level = _rekey(level, max_bits)
        side = F.col("fp").bitwiseAND(F.col("wild"))
        buckets = level.groupBy(*BUCKET).agg(
            F.count("*").alias("n"), F.min(side).alias("s0"), F.max(side).alias("s1")) \
            .filter((F.col("n") > 1) & ((F.col("wild") == 0) | (F.col("s0") != F.col("s1")))) \
            .select(*BUCKET, "n")
        # exploded 66 times: by the size of ``fps`` Spark would broadcast it
        members = stored(level.join(join_side(buckets, few=False), BUCKET), "simhash-buckets")
        n, large = members.agg(F.count("*"), F.count_if(F.col("n") > SPLIT)).first()
        small = members.filter(F.col("n") <= SPLIT)
        a = small.select(*BUCKET, F.col("fp").alias("a"))
        b = small.select(*BUCKET, F.col("fp").alias("b"))
        differ = F.col("a").bitwiseXOR(F.col("b"))
        found.append(a.join(join_side(b, n - large <= BROADCAST_ROWS), BUCKET).filter(
            (F.col("a") < F.col("b")) & (differ.bitwiseAND(F.col("wild")) == F.col("wild"))
            & (F.bit_count(differ) <= max_bits)).select("a", "b"))
        if not large:
            break
        level = members.filter(F.col("n") > SPLIT)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    return pairs.distinct()


def components(links: DataFrame) -> DataFrame:
    """(fp, root): the smallest fingerprint reachable, for each linked fingerprint."""
    def state(edges: DataFrame):
        return tuple(edges.agg(F.count("*"), F.sum(
            F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = stored(links.select("a", "b"), "links")
    before = state(edges)
    while before[0]:
        few = 2 * before[0] <= BROADCAST_ROWS  # a link has two ends
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        # large star: greater neighbours hang on the smallest node around
        edges = both.filter("b > a").join(join_side(least, few), "a").select(
            F.col("m").alias("a"), "b").filter("a != b").distinct()
        # small star: smaller neighbours and the node itself do
        least = edges.groupBy("b").agg(F.min("a").alias("m"))
        edges = stored(edges.join(join_side(least, few), "b").select(
            F.explode(F.array(F.struct("m", F.col("a").alias("x")),
                              F.struct("m", F.col("b").alias("x")))).alias("e")).select(
            F.col("e.m").alias("a"), F.col("e.x").alias("b")).filter("a != b").distinct(),
            "links")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("b").alias("fp"), F.col("a").alias("root"))


def group(rows: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, root, component_id, n_rows) of each distinct fingerprint of (doc_id, fp) rows;
    ``n_rows`` counts the rows of the whole component."""
    classes = stored(rows.groupBy("fp").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("n")), "fingerprints")
    roots = components(link_pairs(classes.select("fp"), max_bits))
    roots = join_side(roots, roots.count() <= BROADCAST_ROWS)
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    whole = rooted.groupBy("root").agg(
        F.min("least").alias("component_id"), F.sum("n").alias("n_rows"))
    return rooted.select("fp", "root").join(join_side(whole, few=False), "root")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS
                    ) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row."""
    rows = stored(with_fingerprints(docs, shingle), "doc-fingerprints")
    groups = group(rows, max_bits).select("fp", "component_id")
    return rows.join(join_side(groups, few=False), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Up to this many ids (some 100 MB) are broadcast to find the rows of groups; beyond, a join
#: by shuffle does the same.
BROADCAST_IDS = 1_000_000


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component one row stays, that
    of the smallest doc_id (of several such rows, the one with the smallest values)."""
    rows = stored(with_fingerprints(docs, shingle), "doc-fingerprints")
    busy = group(rows, max_bits).filter("n_rows > 1").select("fp", "root", "component_id")
    # every row of the components of several rows, by id and fingerprint
    members = stored(rows.join(join_side(busy, few=False), "fp"), "members")
    ids = members.select(F.col("doc_id").alias(OWN["id"])).distinct()
    ids = join_side(ids, ids.count() <= BROADCAST_IDS)
    on = F.col("doc_id").eqNullSafe(F.col(OWN["id"]))
    free = docs.join(ids, on, "left_anti")
    # a repeated id may be busy with one text and free with another: match by fingerprint
    held = _keep_fingerprint(docs.join(ids, on, "left_semi"), shingle)
    groups = members.select(F.col("fp").alias(OWN["fp"]), F.col("root").alias(OWN["root"]),
                            F.col("component_id").alias(OWN["least"])).distinct()
    groups = join_side(groups, groups.count() <= BROADCAST_ROWS)
    keep = docs.columns
    marked = held.join(groups, OWN["fp"], "left")
    first = marked.filter(F.col(OWN["root"]).isNotNull()
                          & F.col("doc_id").eqNullSafe(F.col(OWN["least"])))
    row = F.struct(*keep)
    # rows of the smallest id are few but for repeated ids, which combine before the shuffle
    chosen = first.groupBy(OWN["root"]).agg(F.min_by(row, F.struct(*_orderable(docs))).alias(
        OWN["row"])).select(F.col(OWN["row"] + ".*"))
    return free.select(*keep).unionByName(
        marked.filter(F.col(OWN["root"]).isNull()).select(*keep)).unionByName(
        chosen.select(*keep))


#: Names of working columns, apart from any that the documents may carry.
OWN = {x: f"__simhash_{x}" for x in ("id", "fp", "root", "least", "row")}


def _orderable(docs: DataFrame) -> list[str]:
    """Columns that rows can be ordered by, the text first."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return ["text", *[c for c, k in kinds.items() if c != "text" and "map<" not in k
                      and "variant" not in k]]


def _keep_fingerprint(docs: DataFrame, shingle: int) -> DataFrame:
    """All columns and the fingerprint."""
    names = docs.columns

    def run(batches):
        for batch in batches:
            fp = fingerprints(strings(batch.column(names.index("text"))), shingle)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(fp.view(np.int64))], [*names, OWN["fp"]])

    fields = [*docs.schema.fields, StructField(OWN["fp"], LongType())]
    return docs.mapInArrow(run, StructType(fields))
