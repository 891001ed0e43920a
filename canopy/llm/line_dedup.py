"""Line dedup (6): overlapping three-line windows, DataFrame functions only.

Lines are the parts of a text between line feeds.  Blank lines (white space only) take
no part and stay.  Every run of ``width`` further lines is a window, hashed to 128 bits
from its lines' hashes.  A window that occurs again is kept where it comes first, by
document id (null ids last), then text hash and position; every line that a later
occurrence covers is removed, overlapping windows merged.  Each distinct line removed
still stands in an earlier place.

The first occurrences are an aggregate (combined before the shuffle), not a window
function, so a passage that a third of all texts share fills no task; only windows
that occur more than once are joined back.

Defined cases: a null text stays null, with no lines; texts of fewer than ``width``
lines have no window and stay; rows equal in id and text count as one document and
are treated alike; a text of which all lines go becomes empty; further columns pass
through unchanged, but for ``n_lines`` and ``n_removed``, which are replaced; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import join_side, stored

WIDTH = 3
# names of working columns, apart from any that the documents may carry
GONE, ID, HASH, OWN_HASH, LINES = (f"__lines_{x}" for x in ("gone", "id", "hash", "own", "split"))


def _windows(docs: DataFrame, width: int) -> DataFrame:
    """(first line position, doc key, window key) of every window, without its text."""
    lines = F.split("text", "\n", -1)
    hashed = F.transform(lines, lambda x, i: F.struct(
        i.alias("i"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit("second"), x).alias("b"),
        F.rlike(x, F.lit(r"\S")).alias("full")))
    full = F.filter(hashed, lambda x: x["full"])
    # one-element generator: the array is computed once, not for every use below
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"),
                       F.explode(F.array(full)).alias("ls"))
    part = [F.expr(f"ls[s + {k}]") for k in range(width)]
    return base.filter(F.size("ls") >= width).select(
        "doc_id", "text_hash", "ls",
        F.explode(F.sequence(F.lit(0), F.size("ls") - width)).alias("s")).select(
        "doc_id", "text_hash", F.array(*[x["i"] for x in part]).alias("cover"),
        F.xxhash64(*[x["a"] for x in part]).alias("k1"),
        F.xxhash64(*[x["b"] for x in part]).alias("k2"))


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` with ``text`` cleaned, and n_lines and n_removed added (in place of
    columns of these names, if the documents have any)."""
    docs = docs.drop("n_lines", "n_removed")
    windows = stored(_windows(docs.select("doc_id", "text"), width), "line-windows")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash",
                     F.col("cover")[0].alias("at"))
    firsts = windows.groupBy("k1", "k2").agg(
        F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").drop("n")
    later = windows.join(join_side(firsts, few=False), ["k1", "k2"]).filter(
        ~place.eqNullSafe(F.col("first")))
    gone = later.groupBy("doc_id", "text_hash").agg(
        F.array_distinct(F.flatten(F.collect_list("cover"))).alias(GONE)).select(
        F.col("doc_id").alias(ID), F.col("text_hash").alias(HASH), GONE)
    keyed = docs.withColumn(OWN_HASH, F.xxhash64("text"))
    joined = keyed.join(gone, F.expr(f"doc_id <=> {ID} and {OWN_HASH} = {HASH}"), "left")
    # split once, for the texts that lose lines; a generator's output is not computed anew
    joined = joined.withColumn(LINES, F.explode(F.array(
        F.when(F.col(GONE).isNotNull(), F.split("text", "\n", -1)))))
    kept = F.array_except(F.sequence(F.lit(0), F.size(LINES) - 1), F.col(GONE))
    text = F.when(F.col(GONE).isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(F.col(LINES), i)), "\n"))
    feeds = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    own = [F.col(c) if c != "text" else text.alias("text") for c in docs.columns]
    return joined.select(
        *own, F.coalesce(feeds + 1, F.lit(0)).alias("n_lines"),
        F.when(F.col(GONE).isNull(), 0).otherwise(F.size(GONE)).alias("n_removed"))
