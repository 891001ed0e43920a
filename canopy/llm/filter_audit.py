"""Filter interaction audit (11): what each filter removes in every order of the filters.

Five filters judge a text (``FILTERS``).  Each row gets an ascending row id, and for
every part (language) and id range of at most ``RANGE`` ids one row holds the sorted lists of
the ids that fail each filter, besides the ids labelled good and toxic.  The lists of a range
are merged on their own, so a part of any size is spread over its ranges:

* the union of the lists of a set of filters is a k-way merge of sorted runs (timsort, which
  gallops through runs);
* what a filter removes after a set of filters is its list less that union, and the good and
  toxic ids lost are those lists met with it; positions in the longer list are found by
  galloping, block by block.

Only sizes leave a range: one row of sums for each (part, filter, set of earlier filters).
Added over the ranges they give the steps of all orders.

Filters: A under ``MIN_WORDS`` words; B fewer than 80 distinct words in 100; C more than 10
capitals A-Z in 100 code points; D one of the characters of ``MARKS``; E a text equal to that
of a smaller doc_id anywhere in the table.  Words are maximal runs without ASCII white space.

Defined cases: a null text is empty (and equals the empty text); a null lang is the part '';
a null doc_id is neither smaller nor larger than another, so its row never fails E; rows of
equal id and text are rows of their own and do not fail E through each other; a document is
good or toxic if any label row of its id says so, and neither if none does; further columns
are ignored; long texts are measured in pieces; an empty table gives no rows.
"""

from __future__ import annotations

import math
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import release_memory, stored, strings, text_pieces, utf8_parts

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_SHARE, CAPITAL_SHARE = 100, 80, 10
MARKS = "#$%&*|"
RANGE = 1 << 16  # ids of a range, so elements of a list at most
BLOCK = 256  # ids that are sought together in the longer list


# --------------------------------------------------------------- the filters ----
def _figures(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """(words, distinct words, capitals, code points, marked) of each text."""
    n = len(texts)
    words, distinct = np.zeros(n, np.int64), np.zeros(n, np.int64)
    capitals, points = np.zeros(n, np.int64), np.zeros(n, np.int64)
    marked = np.zeros(n, bool)
    mark = np.zeros(256, bool)
    mark[list(MARKS.encode())] = True
    sizes = np.diff(utf8_parts(texts)[1])
    seen: dict[int, pa.Array] = {}  # distinct words of texts that come in several pieces
    for pieces, rows in text_pieces(texts):
        data, off = utf8_parts(pieces)
        owner = np.repeat(rows, np.diff(off))
        capitals += np.bincount(owner[(data >= 65) & (data <= 90)], minlength=n)
        points += np.bincount(owner[(data & 0xC0) != 0x80], minlength=n)
        marked[owner[mark[data]]] = True
        lists = pc.ascii_split_whitespace(pieces)
        coded = lists.flatten().dictionary_encode()
        number = np.asarray(coded.indices)
        piece = np.repeat(np.arange(len(pieces)), np.diff(np.asarray(lists.offsets)))
        real = np.asarray(pc.not_equal(coded.dictionary, ""), bool)[number]
        number, piece = number[real], piece[real]
        words += np.bincount(rows[piece], minlength=n)
        pair = np.unique(piece * np.int64(len(coded.dictionary)) + number)
        at, word = np.divmod(pair, max(1, len(coded.dictionary)))
        once = np.bincount(at, minlength=len(pieces))
        whole = np.diff(off) == sizes[rows]
        distinct[rows[whole]] = once[whole]
        for k in np.flatnonzero(~whole):
            own = coded.dictionary.take(pa.array(word[at == k]))
            seen[rows[k]] = pc.unique(pa.concat_arrays([seen[rows[k]], own])) \
                if rows[k] in seen else own
    for row, own in seen.items():
        distinct[row] = len(own)
    return words, distinct, capitals, points, marked


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, h1, h2, size, fails): bits 0 to 3 of fails are filters A to D."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), "text",
        F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2"),
        F.octet_length(text).cast("long").alias("size"))

    def judge(batches):
        for batch in batches:
            texts = strings(batch.column("text"))
            words, distinct, capitals, points, marked = _figures(texts)
            fails = ((words < MIN_WORDS) * 1 + (100 * distinct < DISTINCT_SHARE * words) * 2
                     + (100 * capitals > CAPITAL_SHARE * points) * 4 + marked * 8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "part", "h1", "h2", "size")]
                + [pa.array(fails.astype(np.int32))],
                ["doc_id", "part", "h1", "h2", "size", "fails"])
            release_memory()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        judge, f"doc_id {kind}, part string, h1 long, h2 long, size long, fails int")


def marked_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(row, part, fails, good, toxic) of each document; stored, so row ids stay."""
    judged = stored(failures(docs), "audit-judged")
    firsts = judged.groupBy("h1", "h2", "size").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last")) \
        .filter("first < last").drop("last")
    named = labels.groupBy("doc_id").agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")) \
        .filter("good or toxic")
    late = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    out = judged.join(firsts, ["h1", "h2", "size"], "left").join(named, "doc_id", "left")
    return stored(out.select(
        F.monotonically_increasing_id().alias("row"), "part",
        (F.col("fails") + F.when(late, 16).otherwise(0)).alias("fails"),
        F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic")), "audit-rows")


# ------------------------------------------------------------- posting lists ----
def postings(rows: DataFrame, n_filters: int = len(FILTERS)) -> DataFrame:
    """(part, id_range, n, lists, good, toxic): ``lists`` has the sorted ids that fail each
    filter; the ids of a range are consecutive, so most of it is gathered inside one task."""
    def ids(condition):
        return F.sort_array(F.collect_list(F.when(condition, F.col("row"))))

    fails = [ids(F.col("fails").bitwiseAND(1 << k) != 0) for k in range(n_filters)]
    return rows.groupBy("part", F.floor(F.col("row") / RANGE).alias("id_range")).agg(
        F.count("*").alias("n"), F.array(*fails).alias("lists"),
        ids(F.col("good")).alias("good"), ids(F.col("toxic")).alias("toxic"))


def found(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which ids of ``short`` are in ``long`` (both ascending).  Runs of ``BLOCK`` ids gallop
    through ``long``: steps double until they pass the run's end, then only that window is
    searched."""
    out = np.zeros(len(short), bool)
    low = 0
    for at in range(0, len(short), BLOCK):
        run = short[at:at + BLOCK]
        step = BLOCK
        while low + step < len(long) and long[low + step] < run[-1]:
            step *= 2
        window = long[low:low + step + 1]
        place = np.searchsorted(window, run)
        inside = place < len(window)
        out[at:at + BLOCK][inside] = window[place[inside]] == run[inside]
        low += int(place[-1])
    return out


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ids of ``a`` that are not in ``b``."""
    if len(a) <= len(b):
        return a[~found(a, b)]
    stay = np.ones(len(a), bool)
    stay[np.searchsorted(a, b[found(b, a)])] = False
    return a[stay]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    return int(found(*((a, b) if len(a) <= len(b) else (b, a))).sum())


def union(lists: list[np.ndarray]) -> np.ndarray:
    """K-way merge of ascending lists; timsort takes each list as a run and gallops."""
    both = np.sort(np.concatenate(lists), kind="stable") if lists else np.zeros(0, np.int64)
    return both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both


def range_sums(lists: list[np.ndarray], good: np.ndarray, toxic: np.ndarray):
    """(filter, earlier filters as bits, removed, gone so far, good lost, toxic lost) for every
    filter and set of earlier ones."""
    for earlier in range(1 << len(lists)):
        before = union([x for k, x in enumerate(lists) if earlier >> k & 1])
        for k, own in enumerate(lists):
            if not earlier >> k & 1:
                gone = difference(own, before)
                yield (k, earlier, len(gone), len(before) + len(gone), overlap(gone, good),
                       overlap(gone, toxic))


def interactions(lists: DataFrame, n_filters: int = len(FILTERS)) -> DataFrame:
    """(part, filter, earlier, removed, gone, good_lost, toxic_lost, n): sums over the id
    ranges; ``n`` is the part's number of documents."""
    names = ["part", "filter", "earlier", "removed", "gone", "good_lost", "toxic_lost", "n"]

    def merge(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                def array(values):
                    return np.asarray(values.values, np.int64)
                own = batch.column("lists")[at]
                sums = np.asarray(list(range_sums(
                    [array(own[k]) for k in range(n_filters)],
                    array(batch.column("good")[at]), array(batch.column("toxic")[at]))), np.int64)
                part, n = batch.column("part")[at].as_py(), batch.column("n")[at].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(sums)), *(pa.array(x) for x in sums.T),
                     pa.array(np.full(len(sums), n))], names)

    merged = lists.select("part", "n", "lists", "good", "toxic").mapInArrow(
        merge, "part string, filter long, earlier long, removed long, gone long, "
               "good_lost long, toxic_lost long, n long")
    return merged.groupBy("part", "filter", "earlier").agg(
        *(F.sum(c).alias(c) for c in names[3:]))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step."""
    rows = marked_rows(docs.select("doc_id", "text", "lang"), labels)
    sums = stored(interactions(postings(rows)), "audit-sums")  # 80 rows a part
    steps = [("".join(FILTERS[k] for k in order), at + 1, k, sum(1 << j for j in order[:at]))
             for order in permutations(range(len(FILTERS))) for at, k in enumerate(order)]
    orders = docs.sparkSession.createDataFrame(
        steps, "filter_order string, step int, filter long, earlier long")  # 600 rows
    # orders that put just these filters before this one: earlier! * later!
    last = len(FILTERS) - 1
    ways = F.element_at(F.array(*(F.lit(math.factorial(k) * math.factorial(last - k))
                                  for k in range(last + 1))), F.bit_count("earlier") + 1)
    whole = sums.groupBy("part", "filter").agg(
        F.max(F.when(F.col("earlier") == 0, F.col("removed"))).alias("failing"),
        F.max(F.when(F.bit_count("earlier") == last, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * ways).alias("shapley"))
    return sums.join(F.broadcast(orders), ["filter", "earlier"]) \
        .join(whole, ["part", "filter"]).select(
        "part", "filter_order", "step", (F.col("n") - F.col("gone")).alias("kept"), "removed",
        (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost",
        "toxic_lost", "shapley")
