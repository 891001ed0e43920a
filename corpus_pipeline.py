"""The corpus pipeline: five stages over ``documents``, each an operator of ``canopy.llm``.

A stage takes what the one before kept, written as Parquet and read again.  All but the
last return the columns of ``documents``.

Defined cases, for every stage: an empty table gives no rows.  A null text counts as empty (it
stays null where its row stays); it has no lines, no words and no benchmark window, and gives
the closing token alone.  A null doc_id is an id like others, larger than all; it has no label.
Rows that repeat an id are judged each by their own text; equal rows are near-duplicates of each
other, so one of them stays after the third stage.  Of a group of near-duplicates the row of the
smallest id stays, of several such rows the one of the smallest text, then the other columns.
A score of just the threshold is accepted.  Columns beyond those of ``documents`` are dropped,
whatever their names.  Texts are taken whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm import decontaminate, line_dedup, packing, quality, simhash
from canopy.llm.common import id_remainder, join_side, read_table, stored
from canopy.llm.queries import tokenizer_json

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Contaminated documents up to this many (some 120 MB) are broadcast; more are joined by
#: shuffle.
BROADCAST_DOCS = 1_000_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    scorer = quality.train(docs, read_table(spark, sf_dir, "labels"),
                           id_remainder("doc_id", 5) != 0)
    return quality.score(docs.select(*COLUMNS), scorer, keep=COLUMNS).filter("predicted = 1").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of repeated windows; n_chars follows the text."""
    clean = line_dedup.remove_repeats(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars"))
                            .otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.one_of_each(docs.select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    found = decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    bad = stored(found.filter("contaminated").select(
        F.col("doc_id").alias("b_id"), F.col("text_hash").alias("b_hash")).distinct(),
        "contaminated")
    bad = join_side(bad, bad.count() <= BROADCAST_DOCS)
    return docs.select(*COLUMNS).withColumn("_hash", F.xxhash64("text")).join(
        bad, F.expr("doc_id <=> b_id and _hash = b_hash"), "left_anti").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_json())


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_neardup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The classifier, the fingerprints and the tokenizer cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
