"""Registry of accepted results keyed by content hash (#5-#8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.operators.replies import SECTION_COLUMNS

RECORD_FIELDS = ["content_hash"] + [c for _, c in SECTION_COLUMNS]


# ----------------------------------------------------------------- #5 ----
def registry_upsert(registry: DataFrame | None, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(registry, rejects): one row per content hash, the latest persist wins.

    Rows without sections (no ``implementation``) are refused.  Order of
    persists is (ts, req_id, attempt).  Partial aggregation keeps a hot hash
    (one implementation repeated by a third of all replies) cheap.
    """
    cols = ["ts", "req_id", "attempt"] + RECORD_FIELDS
    incoming = sections.select(*cols)
    rejects = incoming.where(F.col("implementation").isNull())
    rows = incoming.where(F.col("implementation").isNotNull())
    if registry is not None:
        rows = registry.select(*cols).unionByName(rows)
    latest = (rows.groupBy("content_hash")
              .agg(F.max_by(F.struct(*cols), F.struct("ts", "req_id", "attempt")).alias("r"))
              .select("r.*"))
    return latest, rejects


# ----------------------------------------------------------------- #6 ----
def registry_lookup(registry: DataFrame, keys: DataFrame) -> DataFrame:
    """Every key of a batch of ``content_hash`` keys with its record and ``found``; one join."""
    held = registry.withColumn("found", F.lit(True))
    return keys.join(held, "content_hash", "left").withColumn(
        "found", F.coalesce("found", F.lit(False)))


# ----------------------------------------------------------------- #7 ----
def registry_json(registry: DataFrame) -> DataFrame:
    """One JSON object per record: seven fields in order, nulls written as null."""
    return registry.select("content_hash", F.to_json(
        F.struct(*RECORD_FIELDS), {"ignoreNullFields": "false"}).alias("json"))


def registry_export(registry: DataFrame, path: str) -> None:
    registry_json(registry).select("json").write.mode("overwrite").text(path)


# ----------------------------------------------------------------- #8 ----
def _block(title: str, col: str, first: bool = False) -> F.Column:
    return F.concat(F.lit(("" if first else "\n") + f"=== {title} ===\n"), F.col(col))


def report_text(results: DataFrame) -> DataFrame:
    """Readable report per result.

    ``results`` carries status, content_hash, the section columns (null when
    absent) and the three ambiguity texts (null when no block exists).
    """
    deps = F.col("dependencies")
    parts = [
        _block("Intent Classification", "intent_classification", True),
        _block("Signature", "signature"), _block("Implementation", "implementation"),
        _block("Invariants", "invariants"), _block("Test Oracle", "test_oracle"),
    ]
    sections_text = F.concat_ws(
        "\n", *parts,
        F.when(deps.isNotNull() & (deps != ""), _block("Dependencies", "dependencies")),
        F.concat(F.lit("\n[Hash: "), F.col("content_hash"), F.lit("]")))
    ambiguity = F.concat(
        F.lit("AMBIGUITY DETECTED\n  Unclear: "), F.col("unclear_dimension"),
        F.lit("\n  Question: "), F.col("clarifying_question"),
        F.lit("\n  Assumed: "), F.col("assumed_interpretation"))
    text = (F.when(F.col("unclear_dimension").isNotNull(), ambiguity)
            .when(F.col("implementation").isNull(), F.lit("ERROR: No sections available"))
            .otherwise(sections_text))
    return results.withColumn("report", text)


def report_export(results: DataFrame, path: str) -> None:
    (report_text(results).select("status", "report").write.mode("overwrite")
     .partitionBy("status").text(path))
