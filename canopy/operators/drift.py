"""Drift and regression (#31-#37).

Intent keys are few and hot (a handful of keys hold most rows), so nothing
here uses a window partitioned by key: first hashes come from partial
aggregation (``min_by``) and are joined back, which AQE plans as a broadcast
or skew-split join.  Session numbers (#31) are prefix sums over range partitions,
so that one busy session never has to be sorted in a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions import dims
from canopy.functions.frames import join_on, sessionise
from canopy.session import stored

VIOLATION = ("DETERMINISM_VIOLATION\n  intent_key: %s\n  expected:   %s\n  received:   %s\n"
             "  Investigate before re-running.")


# ---------------------------------------------------------------- #31 ----
def assign_sessions(results: DataFrame, timeout_seconds: float | None = None) -> DataFrame:
    """Add ``session_no``: number of reset rows at or before the row in its session (a reset
    row opens the new session).  With ``timeout_seconds`` a pause of that length ends a session
    as well.  Prefix sums over range partitions, see ``sessionise``."""
    return sessionise(results, "session_id", ["ts", "req_id"], "ts", timeout_seconds, "is_reset")


def gap_sessions(rows: DataFrame, key: str, time_col: str, tie: str,
                 gap_seconds: float) -> DataFrame:
    """Add ``session_no``: sessions of a key end with a pause of ``gap_seconds`` or more.
    ``tie`` orders rows of one time."""
    return sessionise(rows, key, [time_col, tie], time_col, gap_seconds)


# ---------------------------------------------------------------- #32 ----
GROUP = ["session_id", "session_no", "intent_key"]


def check_drift(results: DataFrame, timeout_seconds: float | None = None) -> DataFrame:
    """Per (session, session_no, key): expected = first hash; later different hash
    is a violation with the exact message.  The expected hash is never replaced.

    Only accepted replies have a hash: a row with an empty or null hash neither sets
    the expectation nor violates it, and has none.  The sessioned rows are evaluated once."""
    s = stored(assign_sessions(results, timeout_seconds), "sessioned")
    hashed = F.coalesce(F.col("content_hash") != "", F.lit(False))
    first = s.groupBy(*GROUP).agg(F.min_by(
        F.when(hashed, F.col("content_hash")),
        F.when(hashed, F.struct("ts", "req_id"))).alias("expected"))
    return drift_verdicts(join_on(s, first, GROUP))


def drift_verdicts(rows: DataFrame) -> DataFrame:
    """Rows with the expected hash of their key: add violation and message."""
    hashed = F.coalesce(F.col("content_hash") != "", F.lit(False))
    v = hashed & (F.col("content_hash") != F.col("expected"))
    return (rows.withColumn("expected", F.when(hashed, F.col("expected")))
            .withColumn("violation", v)
            .withColumn("message", F.when(v, F.format_string(
                VIOLATION, F.col("intent_key"), F.col("expected"), F.col("content_hash")))))


def resolved_results(classified: DataFrame, results: DataFrame) -> DataFrame:
    """The input of ``check_drift`` from the pipeline itself: each answered request that passed
    the gate with its intent key and the hash of its accepted reply.  A session is the
    request's own; nothing resets it."""
    c = classified.where(F.col("confidence") == "HIGH").select(
        "req_id", "session_id", "ts", "intent_key")
    return c.join(results.select("req_id", "content_hash"), "req_id").withColumn(
        "is_reset", F.lit(0))


# ---------------------------------------------------------------- #33 ----
def drift_report(checked: DataFrame) -> DataFrame:
    """Keys with more than one hash in a session: counts and first violation time
    (accepted replies only)."""
    return (checked.where(F.col("content_hash") != "").groupBy(*GROUP)
            .agg(F.count("*").alias("n"),
                 F.count_distinct("content_hash").alias("n_hashes"),
                 F.sum(F.col("violation").cast("int")).alias("n_violations"),
                 F.min(F.when(F.col("violation"), F.col("ts"))).alias("first_violation_ts"),
                 F.min_by("content_hash", F.struct("ts", "req_id")).alias("expected"),
                 F.mode("content_hash", True).alias("mode_hash"))
            .where(F.col("n_hashes") > 1))


def drift_variants(results: DataFrame) -> DataFrame:
    """Hash variants of accepted replies per key with their frequency."""
    return (results.where(F.col("content_hash") != "")
            .groupBy("intent_key", "content_hash").agg(F.count("*").alias("n")))


def hash_sketches(results: DataFrame, lg_k: int = 12) -> DataFrame:
    """(intent_key, day, n, sketch): one mergeable distinct-hash sketch per key and day of
    accepted replies, to be kept as a table; a new day adds rows and reads no old ones."""
    return (results.where(F.col("content_hash") != "")
            .groupBy("intent_key", F.to_date("ts").alias("day"))
            .agg(F.count("*").alias("n"), F.hll_sketch_agg("content_hash", lg_k).alias("sketch")))


def sketched_variants(sketches: DataFrame) -> DataFrame:
    """(intent_key, n, n_days, n_hashes): approximate distinct hashes of each key from stored
    sketches; the relative standard error is about 1.04 / sqrt(2 ** lg_k)."""
    return sketches.groupBy("intent_key").agg(
        F.sum("n").alias("n"), F.count("*").alias("n_days"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_hashes"))


# ---------------------------------------------------------------- #35 ----
def first_hashes(results: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return results.where(F.col("content_hash") != "").groupBy(*(keys or ["intent_key"])).agg(
        F.min_by("content_hash", F.struct("ts", "req_id")).alias("content_hash"))


def cross_session_drift(current: DataFrame, baseline: DataFrame,
                        keys: list[str] | None = None) -> DataFrame:
    """Compare first hash per key (by default the intent key; a session id may come
    before it) with a baseline registry: same / changed / new / gone."""
    keys = keys or ["intent_key"]
    b = baseline.select(*keys, F.col("content_hash").alias("baseline_hash"))
    c = current.select(*keys, F.col("content_hash").alias("current_hash"))
    j = b.join(c, keys, "full_outer")
    status = (F.when(F.col("baseline_hash").isNull(), "new")
              .when(F.col("current_hash").isNull(), "gone")
              .when(F.col("baseline_hash").eqNullSafe(F.col("current_hash")), "same")
              .otherwise("changed"))
    return j.withColumn("status", status)


# ---------------------------------------------------------------- #36 ----
def expected_cells(types=dims.TYPES, languages=dims.LANGUAGES) -> F.Column:
    """The type x language grid as a literal array of structs (no join)."""
    return F.array(*[F.struct(F.lit(t).alias("type"), F.lit(l).alias("language"))
                     for t in types for l in languages])


def regression_matrix(runs: DataFrame, canonical_calls: int = 5,
                      synonym_calls: int = 15) -> DataFrame:
    """Per type x language: calls of the canonical phrasing (0) and of its synonyms,
    distinct hashes, status pass / drift / missing / short (too few calls of a kind)."""
    canonical = F.coalesce((F.col("phrasing") == 0).cast("int"), F.lit(0))
    stats = runs.groupBy("type", "language").agg(
        F.count("*").alias("calls"), F.sum(canonical).alias("n_canonical"),
        F.count_distinct("content_hash").alias("n_hashes"))
    grid = runs.sparkSession.range(1).select(F.inline(expected_cells()))
    m = grid.join(stats, ["type", "language"], "left")
    return m.select(
        "type", "language", F.coalesce("calls", F.lit(0)).alias("calls"),
        F.coalesce("n_canonical", F.lit(0)).alias("n_canonical"),
        F.coalesce("n_hashes", F.lit(0)).alias("n_hashes"),
        F.when(F.col("calls").isNull(), "missing")
        .when(F.col("n_hashes") > 1, "drift")
        .when((F.col("n_canonical") < canonical_calls)
              | (F.col("calls") - F.col("n_canonical") < synonym_calls), "short").otherwise("pass").alias("status"))


def regression_cube(runs: DataFrame) -> DataFrame:
    """Calls and distinct hashes per cell with type / language / grand subtotals."""
    return runs.cube("type", "language").agg(
        F.grouping_id().alias("gid"), F.count("*").alias("calls"),
        F.count_distinct("content_hash").alias("n_hashes"))


def regression_pivot(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("type").pivot("language", dims.LANGUAGES).agg(F.first("status"))


# ---------------------------------------------------------------- #37 ----
def synonym_stability(runs: DataFrame) -> DataFrame:
    """Phrasings whose hash set is not the most frequent one of their cell.

    Each phrasing is folded into one row with a signature of its sorted hash set; the
    most frequent signature of a cell (ties: the smallest) is the cell's rule.  The
    report is linear in the phrasings.
    """
    per = _signatures(runs)
    rule = (per.groupBy("type", "language", "sig").agg(F.count("*").alias("n"))
            .groupBy("type", "language").agg(
                F.min_by(F.struct("sig", "n"), F.struct(-F.col("n"), "sig")).alias("rule"))
            .select("type", "language", F.col("rule.sig").alias("rule_sig"),
                    F.col("rule.n").alias("n_agreeing")))
    return (join_on(per, rule, ["type", "language"]).where(F.col("sig") != F.col("rule_sig"))
            .select("type", "language", "phrasing", "n_hashes", "n_agreeing"))


def _signatures(runs: DataFrame) -> DataFrame:
    hashes = F.sort_array(F.collect_set("content_hash"))
    return runs.groupBy("type", "language", "phrasing").agg(hashes.alias("hs")).select(
        "type", "language", "phrasing", F.size("hs").cast("long").alias("n_hashes"),
        F.sha2(F.array_join("hs", ","), 256).alias("sig"))
