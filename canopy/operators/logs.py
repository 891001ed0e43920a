"""Call and span log analytics (#46-#52)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.functions import dims
from canopy.functions import text as T
from canopy.functions.frames import exact_quantiles, join_on, running_sum, value_ranks
from canopy.session import stored


# ---------------------------------------------------------------- #46 ----
def span_latency(log: DataFrame) -> DataFrame:
    """Count, mean, exact p50/p95/p99 and max latency per traced operation.

    The quantiles come from ranks over range partitions (``value_ranks``), so an operation
    with a third of all spans has no reducer of its own; the other figures are aggregates of
    the same counts by value."""
    spans = log.where(F.col("event") == "span_completed").select("operation", "latency_ms")
    ranks = value_ranks(spans, "operation", "latency_ms")
    lat = F.col("latency_ms")
    stats = ranks.groupBy("operation").agg(
        F.sum("n").alias("n"), F.sum(F.when(lat.isNotNull(), F.col("n"))).alias("size"),
        # exact mean of values with two decimals: integer hundredths, one division
        F.sum(F.round(lat * 100).cast("long") * F.col("n")).alias("hundredths"),
        F.max(lat).alias("max_ms"))
    found = exact_quantiles(ranks, stats.select("operation", "size"), "operation",
                            "latency_ms", [0.5, 0.95, 0.99])
    return join_on(stats, found, ["operation"], "left").select(
        "operation", "n", F.round(F.col("hundredths") / F.col("size") / 100, 4).alias("mean_ms"),
        F.round("q0", 4).alias("p50_ms"), F.round("q1", 4).alias("p95_ms"),
        F.round("q2", 4).alias("p99_ms"), "max_ms")


def span_latency_approx(log: DataFrame, accuracy: int = 10000) -> DataFrame:
    """The same report with mergeable quantile sketches (bounded memory per group)."""
    s = log.where(F.col("event") == "span_completed")
    return s.groupBy("operation").agg(
        F.count("*").alias("n"),
        F.round(F.sum(F.round(F.col("latency_ms") * 100).cast("long"))
                / F.count("latency_ms") / 100, 4).alias("mean_ms"),
        F.percentile_approx("latency_ms", [0.5, 0.95, 0.99], accuracy).alias("quantiles"),
        F.max("latency_ms").alias("max_ms"))


# ---------------------------------------------------------------- #47 ----
CALL_KEY = ["trace_id", "span_id"]


START_FIELDS = ["ts", "session_id", "model", "temperature", "max_tokens", "system_prompt_hash",
                "attempt"]
DONE_FIELDS = ["ts", "tokens_in", "tokens_out", "latency_ms", "content_hash"]


def call_records(log: DataFrame) -> DataFrame:
    """(trace_id, span_id, start, done): the earliest start line and the earliest completion
    of each call, null where there is none.  One aggregate, combined before the shuffle."""
    start, done = F.col("event") == "llm_call_start", F.col("event") == "llm_call_complete"
    return log.where(start | done).groupBy(*CALL_KEY).agg(
        F.min(F.when(start, F.struct(*START_FIELDS))).alias("start"),
        F.min(F.when(done, F.struct(*DONE_FIELDS))).alias("done"))


def split_calls(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, orphans) of call records; records of one key are merged."""
    merged = records.groupBy(*CALL_KEY).agg(F.min("start").alias("start"),
                                            F.min("done").alias("done"))
    s, d = F.col("start"), F.col("done")
    flat = merged.select(
        *CALL_KEY, "start", "done", s["ts"].alias("start_ts"),
        *[s[c].alias(c) for c in START_FIELDS[1:]], d["ts"].alias("end_ts"),
        *[d[c].alias(c) for c in DONE_FIELDS[1:]])
    calls = flat.where(s.isNotNull() & d.isNotNull()).drop("start", "done")
    orphans = flat.where(s.isNull() | d.isNull()).withColumn(
        "kind", F.when(d.isNull(), "failed_call").otherwise("complete_without_start")) \
        .drop("start", "done")
    return calls, orphans


def pair_calls(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, orphans): start and complete lines matched on (trace_id, span_id).

    A start without a completion is a failed call (orphan).  A line that is delivered
    again counts once: each key keeps its earliest start and earliest completion."""
    return split_calls(call_records(log))


# ---------------------------------------------------------------- #48 ----
def usage_rollup(calls: DataFrame) -> DataFrame:
    """Tokens, calls and attempts per session / model / hour, with subtotals."""
    return (calls.withColumn("hour", F.date_trunc("hour", "start_ts"))
            .rollup("model", "session_id", "hour")
            .agg(F.grouping_id().alias("gid"), F.count("*").alias("calls"),
                 F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
                 F.sum(F.when(F.col("attempt") > 1, 1).otherwise(0)).alias("retries")))


# ---------------------------------------------------------------- #49 ----
def context_budget(calls: DataFrame, window_tokens: int = 5000,
                   share: float = dims.CONTEXT_ALERT_SHARE) -> DataFrame:
    """First call per session whose running token total crosses share x window."""
    used = calls.withColumn("tokens", F.col("tokens_in") + F.col("tokens_out"))
    run = running_sum(used, "session_id", ["start_ts", "span_id"], "tokens",
                      out="running_tokens")
    limit = window_tokens * share
    crossing = run.where((F.col("running_tokens") >= limit)
                         & (F.col("running_tokens") - F.col("tokens") < limit))
    return crossing.select("session_id", "span_id", "start_ts", "running_tokens",
                           F.lit(window_tokens).alias("window_tokens"))


# ---------------------------------------------------------------- #50 ----
def config_lock_audit(calls_or_starts: DataFrame) -> DataFrame:
    """Violations of the pinned call configuration.

    kind in temperature / model / max_tokens (per call; a missing setting is off its
    pin) and system_prompt (per session with more than one system prompt hash)."""
    c = calls_or_starts
    model = F.col("model")
    per_call = c.select(
        "session_id", "span_id",
        F.filter(F.array(
            F.when(~F.col("temperature").eqNullSafe(dims.PINNED_TEMPERATURE),
                   F.lit("temperature")),
            F.when(~model.eqNullSafe(dims.PINNED_MODEL) | model.contains("latest")
                   | model.contains("preview"), F.lit("model")),
            F.when(~F.col("max_tokens").eqNullSafe(dims.PINNED_MAX_TOKENS),
                   F.lit("max_tokens"))),
            lambda x: x.isNotNull()).alias("kinds"))
    calls_v = per_call.select("session_id", "span_id", F.explode("kinds").alias("kind"))
    sessions_v = (c.groupBy("session_id")
                  # more than one hash: one combined aggregate instead of distinct rows
                  .agg(F.min("system_prompt_hash").alias("low"),
                       F.max("system_prompt_hash").alias("high"))
                  .where(F.col("low") != F.col("high"))
                  .select("session_id", F.lit(None).cast("string").alias("span_id"),
                          F.lit("system_prompt").alias("kind")))
    return calls_v.unionByName(sessions_v)


# ---------------------------------------------------------------- #51 ----
def prompt_audit(requests: DataFrame) -> DataFrame:
    """One row per request: prompt hash of the raw text, session, time, type, and
    whether the same prompt was already sent earlier in the session.

    One pass: classification columns are computed on every row and kept only
    for accepted free-text rows (no join back to a second classification);
    the first request per (session, prompt hash) comes from a partial
    aggregation joined back on that key."""
    from canopy.operators.canonical import canonicalise, classify
    from canopy.sources.ingest import ingest_requests
    c = classify(canonicalise(ingest_requests(requests)))
    keep = (F.col("status") == "ok") & (F.col("source") == "freetext")
    r = c.select("req_id", "session_id", "ts", T.hash16(F.col("text")).alias("prompt_hash"),
                 F.when(keep, F.col("intent_type")).alias("intent_type"),
                 F.when(keep, F.col("confidence")).alias("confidence"))
    first = r.groupBy("session_id", "prompt_hash").agg(
        F.min_by("req_id", F.struct("ts", "req_id")).alias("first_req_id"))
    return (join_on(r, first, ["session_id", "prompt_hash"])
            .select("req_id", "session_id", "ts", "prompt_hash", "intent_type", "confidence",
                    (F.col("req_id") != F.col("first_req_id")).alias("repeated")))


# ---------------------------------------------------------------- #52 ----
FUNNEL = ["requests", "ingested", "understood", "passed_gate", "answered", "accepted"]


def request_outcomes(classified: DataFrame, results: DataFrame) -> DataFrame:
    """How far each request came: (req_id, source, reached, reason, prompt_id, content_hash).

    ``classified`` is ``classify_all`` of the requests (free text and specs), ``results`` has
    one row per answered request.  ``reached`` counts the stages of ``FUNNEL`` passed;
    ``reason`` says why a request went no further: the kind of its error, its confidence, or
    the status of its result; null for accepted ones."""
    from canopy.operators.canonical import bind_prompts
    ingest_error = F.coalesce(F.col("rejected"), F.lit(False))
    r = results.select("req_id", F.col("status").alias("result"), "content_hash")
    j = bind_prompts(classified).join(r, "req_id", "left")
    passed = F.col("confidence") == "HIGH"
    reached = (F.when(ingest_error, 1).when(F.col("error").isNotNull(), 2).when(~passed, 3)
               .when(F.col("result").isNull(), 4).when(F.col("result") != "ok", 5).otherwise(6))
    # the kind is the text before the colon, without the row's own values
    reason = F.coalesce(F.regexp_extract("error", "^[^:]+", 0), F.when(~passed, F.col("confidence")),
                        F.when(F.col("result").isNull(), "no result"),
                        F.when(F.col("result") != "ok", F.col("result")))
    return j.select("req_id", "source", reached.alias("reached"), reason.alias("reason"),
                    F.when(passed, F.col("prompt_id")).alias("prompt_id"),
                    F.when(reached == 6, F.col("content_hash")).alias("content_hash"))


def funnel_counts(outcomes: DataFrame) -> DataFrame:
    """(source, reached, reason, prompt_id, content_hash, n): the outcomes counted in one pass
    and stored, for the reports below."""
    per = outcomes.groupBy("source", "reached", "reason", "prompt_id", "content_hash").agg(
        F.count("*").alias("n"))
    return stored(per, "funnel")


def pipeline_funnel(per: DataFrame) -> DataFrame:
    """Rows reaching each stage with the conversion from the stage before, distinct prompts
    and registry records; ``per`` is ``funnel_counts``."""
    counts = per.agg(
        *[F.sum(F.when(F.col("reached") >= k, F.col("n")).otherwise(0)).alias(s)
          for k, s in enumerate(FUNNEL, 1)],
        F.count_distinct("prompt_id").alias("distinct_prompts"),
        F.count_distinct("content_hash").alias("registry_records"))
    names = [*FUNNEL, "distinct_prompts", "registry_records"]
    # from one row: each stage beside the one before
    rows = F.array(*[F.struct(
        F.lit(k).alias("stage_no"), F.lit(s).alias("stage"),
        F.coalesce(F.col(s), F.lit(0)).alias("n"),
        F.round(F.col(s) / F.col(names[k - 2]), 4).alias("conversion") if 1 < k <= len(FUNNEL)
        else F.lit(None).cast("double").alias("conversion")) for k, s in enumerate(names, 1)])
    return counts.select(F.inline(rows))


def funnel_losses(per: DataFrame) -> DataFrame:
    """(lost_after, source, reason, n): why requests of each branch went no further."""
    stage = F.element_at(F.array(*[F.lit(s) for s in FUNNEL]), F.col("reached"))
    return (per.where(F.col("reason").isNotNull())
            .groupBy(stage.alias("lost_after"), "source", "reason").agg(F.sum("n").alias("n")))
