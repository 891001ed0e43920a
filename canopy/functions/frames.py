"""DataFrame helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def settle(df: DataFrame, derived: list[str] | None = None) -> DataFrame:
    """Evaluate the ``derived`` columns once, even if a later filter reads them.

    Catalyst pushes a filter below the projections that define its columns by
    substituting their expressions; for text-heavy columns (regex over whole
    replies / documents) that re-runs the regexes inside the filter, once per
    reference.  Passing the derived columns through a one-element ``inline``
    turns them into generator output, which a filter on them cannot be pushed
    below, so each expression is computed exactly once per row in generated
    code.  The other (pass-through) columns stay plain child columns: filters
    on them still reach the scan and unused ones are still pruned.
    """
    derived = list(df.columns) if derived is None else derived
    rest = [c for c in df.columns if c not in derived]
    return df.select(*rest, F.inline(F.array(F.struct(*[F.col(c) for c in derived]))))


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where null equals null; the left side's key columns stay."""
    named = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c)
                           for c in right.columns])
    on = None
    for k in keys:
        same = left[k].eqNullSafe(named[f"_r_{k}"])
        on = same if on is None else on & same
    return left.join(named, on, how).drop(*[f"_r_{k}" for k in keys])


def ranged(df: DataFrame, key: str, order: list[str], label: str) -> DataFrame:
    """``df`` stored in range partitions by (key, *order), with ``__key`` (the key as a struct,
    in which null equals null) and ``__part``.

    Spark samples the splitters, so a key that holds a third of all rows spans many parts,
    however its rows lie in time; only rows equal in key and order columns stay together."""
    from canopy.session import stored
    return stored(df.repartitionByRange(key, *order)
                  .withColumn("__key", F.struct(F.col(key).alias("k")))
                  .withColumn("__part", F.spark_partition_id()), label)


def _inside(order: list[str]) -> Window:
    return Window.partitionBy("__key", "__part").orderBy(*order)


def _parts() -> Window:
    """The parts of one key, in order; at most as many rows as there are range partitions."""
    return Window.partitionBy("__key").orderBy("__part")


_HELPERS = ("__key", "__part")


def running_sum(df: DataFrame, key: str, order: list[str], value: str,
                out: str = "running") -> DataFrame:
    """Running total of ``value`` per ``key`` in ``order`` (rows up to and including the
    current one), as a two-level prefix sum over range partitions.

    A plain window partitioned by ``key`` sorts a whole key in one task.  Here a window runs
    inside each (key, range part), and what earlier parts of the key add up to comes from one
    row per part.  Null values add nothing; null keys are one key; nulls sort first."""
    r = ranged(df, key, order, "running-sum")
    within = r.withColumn("__in", F.sum(value).over(
        _inside(order).rowsBetween(Window.unboundedPreceding, 0)))
    before = r.groupBy(*_HELPERS).agg(F.sum(value).alias("__n")).select(
        *_HELPERS, F.coalesce(F.sum("__n").over(
            _parts().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return (within.join(before, list(_HELPERS))
            .withColumn(out, F.col("__before") + F.coalesce("__in", F.lit(0)))
            .drop(*_HELPERS, "__in", "__before"))


def sessionise(df: DataFrame, key: str, order: list[str], time_col: str,
               gap_seconds: float | None = None, reset: str | None = None,
               out: str = "session_no") -> DataFrame:
    """Number each key's sessions from 0.  A new one starts at a row with ``reset`` = 1, and at
    one that comes ``gap_seconds`` or more after the row before.

    Rows are cut into range parts as in ``running_sum``.  A part counts the starts inside it;
    its first row is compared with the last time of the part before by a pass over one row per
    part, which also adds up the starts.  A key's rows are never gathered in one task.  A row
    without a time never starts a session by a gap."""
    r = ranged(df, key, order, "sessions")
    r = r.withColumn("__us", F.unix_micros(F.col(time_col).cast("timestamp")))
    starts = F.coalesce(F.col(reset) == 1, F.lit(False)) if reset else F.lit(False)
    limit = None if gap_seconds is None else round(gap_seconds * 1_000_000)
    late = F.lit(False) if limit is None else F.coalesce(
        F.col("__us") - F.lag("__us").over(_inside(order)) >= limit, F.lit(False))
    rows = r.withColumn("__b", (starts | late).cast("long"))
    within = rows.withColumn("__in", F.sum("__b").over(
        _inside(order).rowsBetween(Window.unboundedPreceding, 0)))
    parts = rows.groupBy(*_HELPERS).agg(
        F.sum("__b").alias("n"), F.min("__us").alias("first"), F.max("__us").alias("last"),
        F.min_by("__b", F.struct(*order)).alias("opens"))
    parts = parts.withColumn("cross", F.lit(0) if limit is None else F.coalesce(
        ((F.col("first") - F.lag("last").over(_parts()) >= limit) & (F.col("opens") == 0))
        .cast("long"), F.lit(0)))
    before = parts.select(*_HELPERS, (F.coalesce(F.sum(F.col("n") + F.col("cross")).over(
        _parts().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("cross"))
        .alias("__before"))
    return (within.join(before, list(_HELPERS))
            .withColumn(out, F.col("__before") + F.col("__in"))
            .drop(*_HELPERS, "__us", "__b", "__in", "__before"))


def value_ranks(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, n, up_to): the distinct values of each group with their count and how
    many rows of the group hold this value or a smaller one (rows without a value: up_to 0).

    Rows are counted by value before anything is sorted, and the counts are summed over range
    partitions, so no group's values have to meet in one task."""
    counts = df.groupBy(F.col(group), F.col(value)).agg(F.count("*").alias("n")).withColumn(
        "__w", F.when(F.col(value).isNull(), 0).otherwise(F.col("n")))
    return running_sum(counts, group, [value], "__w", out="up_to").drop("__w")


def exact_quantiles(ranks: DataFrame, totals: DataFrame, group: str, value: str,
                    shares: list[float]) -> DataFrame:
    """(group, q0, q1, ...) from ``value_ranks``, interpolated between neighbouring ranks.

    ``totals`` has (group, size): the number of rows with a value.  The value at rank k (from
    0) is the smallest one that more than k rows do not exceed, a plain aggregate."""
    r = join_on(ranks.where(F.col(value).isNotNull()), totals, [group])
    picks = []
    for i, share in enumerate(shares):
        at = F.lit(share) * (F.col("size") - 1)
        picks += [F.min(F.when(F.col("up_to") > F.floor(at), F.col(value))).alias(f"_lo{i}"),
                  F.min(F.when(F.col("up_to") > F.ceil(at), F.col(value))).alias(f"_hi{i}"),
                  F.max(at - F.floor(at)).alias(f"_at{i}")]
    found = r.groupBy(group).agg(*picks)
    return found.select(group, *[
        (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_at{i}"))
        .alias(f"q{i}") for i in range(len(shares))])
