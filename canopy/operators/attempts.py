"""Attempts and retries (#27-#30).

One aggregation per request id (partial aggregation on the map side); a
request has at most ``max_retries`` attempts, so no group is large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions import dims
from canopy.functions import text as T

TERMINAL = ("ok", "ambiguity")


# ---------------------------------------------------------------- #27 ----
def resolve_attempts(validated: DataFrame, max_retries: int = dims.MAX_RETRIES,
                     carry: list[str] | None = None) -> DataFrame:
    """First terminal attempt (ok / ambiguity) within the budget, else failed.

    results(req_id, status, attempt, attempts_used, content_hash, error, *carry)
    ``carry`` names columns of the winning attempt to keep (e.g. its sections),
    so consumers need no second pass and no join back to the attempts.
    """
    carry = carry or []
    terminal = F.col("status").isin(*TERMINAL) & (F.col("attempt") <= max_retries)
    first = (validated.groupBy("req_id")
             .agg(F.min_by(F.struct("attempt", "status", "content_hash", *carry),
                           F.when(terminal, F.col("attempt"))).alias("t"),
                  F.max(F.when(F.col("attempt") <= max_retries, F.col("attempt"))).alias("seen")))
    ok = F.col("t").isNotNull() & F.col("t.attempt").isNotNull()
    return first.select(
        "req_id",
        F.when(ok, F.col("t.status")).otherwise("failed").alias("status"),
        F.when(ok, F.col("t.attempt")).alias("attempt"),
        F.when(ok, F.col("t.attempt")).otherwise(F.least(F.col("seen"), F.lit(max_retries)))
        .alias("attempts_used"),
        F.when(ok, F.col("t.content_hash")).otherwise(F.lit("")).alias("content_hash"),
        F.when(~ok, F.lit(f"Schema validation failed after {max_retries} attempts")).alias("error"),
        *[F.when(ok, F.col(f"t.{c}")).alias(c) for c in carry],
    )


# ---------------------------------------------------------------- #28 ----
def expand_retry_prompts(prompts: DataFrame, results: DataFrame,
                         max_retries: int = dims.MAX_RETRIES) -> DataFrame:
    """Prompt sent at every attempt actually made: base + suffix repeated n-1 times.

    ``prompts(req_id, user_message)``; ``results`` from ``resolve_attempts``.
    """
    used = results.select("req_id", "attempts_used")
    p = prompts.join(used, "req_id")
    return (p.select("req_id", "user_message",
                     F.explode(F.sequence(F.lit(1), F.col("attempts_used"))).alias("attempt"))
            .withColumn("prompt", F.concat(F.col("user_message"),
                                           F.expr(f"repeat({_sql_str(dims.RETRY_SUFFIX)}, attempt - 1)")))
            .select("req_id", "attempt", "prompt"))


def _sql_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


# ---------------------------------------------------------------- #29 ----
def retry_stats(validated: DataFrame, results: DataFrame) -> DataFrame:
    """Requests by attempts used and outcome, with cumulative share of resolved."""
    h = results.groupBy("attempts_used", "status").agg(F.count("*").alias("n"))
    w = Window.partitionBy("status").orderBy("attempts_used").rowsBetween(
        Window.unboundedPreceding, 0)
    # the histogram has at most max_retries x 3 rows, so these windows are tiny
    total = Window.partitionBy("status")
    return (h.withColumn("cumulative", F.sum("n").over(w))
            .withColumn("cumulative_share", F.round(F.col("cumulative") / F.sum("n").over(total), 4)))


def exhausted_reasons(validated: DataFrame, results: DataFrame) -> DataFrame:
    """Failure reasons of the attempts of requests that ran out of budget."""
    failed = results.where(F.col("status") == "failed").select("req_id")
    return (validated.join(failed, "req_id", "left_semi")
            .groupBy("attempt", "status").agg(F.count("*").alias("n")))


# ---------------------------------------------------------------- #30 ----
def collect_sub_results(parts: DataFrame) -> DataFrame:
    """Ordered list of part outcomes per original request.

    ``parts(req_id, pos, status, detail)``; a failed part keeps its error text
    and does not drop the other parts.
    """
    return (parts.groupBy("req_id")
            .agg(F.sort_array(F.collect_list(F.struct("pos", "status", "detail"))).alias("items"),
                 F.count("*").alias("n_parts"),
                 F.sum(F.when(F.col("status") == "passed", 1).otherwise(0)).alias("n_passed"),
                 F.sum(F.when(F.col("status") == "failed", 1).otherwise(0)).alias("n_failed"))
            .select("req_id", "n_parts", "n_passed", "n_failed",
                    F.array_join(F.transform("items", lambda s: s["status"]), ",").alias("statuses"),
                    F.array_join(F.transform("items", lambda s: s["detail"]), "|").alias("details")))


def prompt_hash(c: F.Column) -> F.Column:
    return T.hash16(c)
