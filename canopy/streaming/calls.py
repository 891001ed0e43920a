"""Log ingest (#3) and call pairing (#47) as streams.

1. ``advance_log``: every micro-batch of lines is parsed once and goes to two folders per
   epoch, typed rows and corrupt lines.  A repeated batch overwrites both.
2. ``advance_calls``: every micro-batch of typed rows is paired inside the batch.  What is
   complete is written; only starts and completions without their partner go on.
3. These meet their partners in keyed state.  A timer gives up after ``patience_seconds`` and
   emits the line as an orphan.

So state and its Python function see the calls that span batches, not every line.  Each
record holds the earliest start and completion its step knew; ``read_calls`` merges the
records of a key by the same rule, so lines that come twice, late, or after their partner was
given up count as in the batch operator, and the source is never read again.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from canopy.operators.logs import CALL_KEY, call_records, split_calls
from canopy.sources.logs import ingest_log
from canopy.streaming.streams import (
    CLOCK_DELAY,
    _text_key,
    batch_clock,
    for_each_batch,
    rocksdb_state,
    run_available,
)


# ----------------------------------------------------------------- #3 ----
def advance_log(lines_stream: DataFrame, out: str) -> None:
    """Parse all lines that have arrived into ``out/log`` and ``out/corrupt``."""

    def split(batch: DataFrame, epoch: int) -> None:
        # each sink reads the batch's own files: kept lines would be as large as their text
        log, corrupt = ingest_log(batch.select("line"))
        log.write.mode("overwrite").parquet(f"{out}/log/epoch={epoch}")
        corrupt.write.mode("overwrite").parquet(f"{out}/corrupt/epoch={epoch}")

    for_each_batch(lines_stream, out + "/_ingest", split)


def read_log(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(log, corrupt) of all batches so far."""
    return (spark.read.parquet(out + "/log").drop("epoch"),
            spark.read.parquet(out + "/corrupt").drop("epoch"))


# ---------------------------------------------------------------- #47 ----
OPEN = "call string, record string, has_start boolean, has_done boolean, clock timestamp"
RESOLVED = "call string, start_record string, done_record string"


#: Groups that the open calls are dealt to.  One call of the state function serves a group, as
#: one per call costs far more than the work on it.
CALL_GROUPS = 1024


class OpenCalls(StatefulProcessor):
    """State per group of calls: of each open call the record of its start line, that of its
    completion (JSON) and the time (ms) at which it is given up; one timer at the earliest."""

    def __init__(self, patience_seconds: float):
        self.patience_ms = round(patience_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "call string, start string, done string, due long")
        self.timer = handle.getValueState("timer", "due long")

    def _open(self) -> dict:
        return {c: (s, d, due) for c, s, d, due in self.held.get()} if self.held.exists() else {}

    def _keep(self, calls: dict) -> None:
        if calls:
            self.held.put([(c, *v) for c, v in calls.items()])
        elif self.held.exists():
            self.held.clear()
        due = min((v[2] for v in calls.values()), default=None)
        before = self.timer.get()[0] if self.timer.exists() else None
        if due == before:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        if due is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(due)
            self.timer.update((due,))

    def handleInputRows(self, key, rows, timerValues):
        calls, clocks, out = self._open(), {}, []
        for pdf in rows:
            pdf = pdf[pdf["has_start"] | pdf["has_done"]]
            ms = [int(t.timestamp() * 1000) for t in pdf["clock"]]
            for call, record, is_start, at in zip(pdf["call"], pdf["record"], pdf["has_start"],
                                                  ms, strict=True):
                start, done, due = calls.get(call, (None, None, -1))
                clocks[call] = max(clocks.get(call, 0), at)
                # a second line of one kind is passed on; records are merged when read
                if is_start and start is None:
                    start = record
                elif not is_start and done is None:
                    done = record
                else:
                    out.append((call, record if is_start else None, None if is_start else record))
                calls[call] = (start, done, due)
        for call, clock in clocks.items():
            start, done, _ = calls[call]
            if start is not None and done is not None:
                out.append((call, start, done))
                del calls[call]
            else:
                calls[call] = (start, done, clock + self.patience_ms)
        self._keep(calls)
        yield pd.DataFrame(out, columns=["call", "start_record", "done_record"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        calls = self._open()
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        given_up = [(c, s, d) for c, (s, d, due) in calls.items() if due <= now]
        self.timer.clear()  # this timer is gone
        self._keep({c: v for c, v in calls.items() if v[2] > now})
        yield pd.DataFrame(given_up, columns=["call", "start_record", "done_record"])

    def close(self) -> None:
        pass


def advance_calls(log_stream: DataFrame, out: str, patience_seconds: float = 86_400,
                  close: bool = False) -> None:
    """Pair all log rows that have arrived.  ``close`` moves the clock past every timer, so
    what still waits is given up as orphans."""
    spark = log_stream.sparkSession

    def pair(batch: DataFrame, epoch: int) -> None:
        records = call_records(batch)
        path = f"{out}/records/epoch={epoch}"
        records.write.mode("overwrite").parquet(path)
        held = spark.read.schema(records.schema).parquet(path)
        us = F.unix_micros(F.coalesce(F.greatest("start.ts", "done.ts"), "start.ts", "done.ts")
                           .cast("timestamp"))
        _, clock = batch_clock(spark, out + "/clock", epoch, held.agg(F.max(us)).first()[0])
        lone = held.where(F.col("start").isNull() | F.col("done").isNull())
        lone.select(F.to_json(F.array(*[_text_key(c) for c in CALL_KEY])).alias("call"),
                    F.to_json(F.struct(*held.columns)).alias("record"),
                    F.col("start").isNotNull().alias("has_start"),
                    F.col("done").isNotNull().alias("has_done"),
                    F.timestamp_micros(F.lit(clock)).alias("clock")) \
            .write.mode("overwrite").parquet(f"{out}/open/epoch={epoch:012d}")

    for_each_batch(log_stream, out + "/_pair", pair)
    if close:
        # a record without lines: it only carries the clock
        last = spark.read.parquet(out + "/clock").agg(F.max("us")).first()[0] or 0
        ahead = last + round(2 * patience_seconds * 1_000_000) + 1_000_000
        spark.range(1).select(
            F.lit("").alias("call"), F.lit(None).cast("string").alias("record"),
            F.lit(False).alias("has_start"), F.lit(False).alias("has_done"),
            F.timestamp_micros(F.lit(ahead)).alias("clock")) \
            .write.mode("overwrite").parquet(f"{out}/open/closing")
    waiting = spark.readStream.schema(OPEN).parquet(out + "/open/*")
    waiting = waiting.withColumn(
        "call_group", F.pmod(F.xxhash64("call"), F.lit(CALL_GROUPS)).cast("int"))
    resolved = waiting.withWatermark("clock", CLOCK_DELAY).groupBy("call_group") \
        .transformWithStateInPandas(OpenCalls(patience_seconds), RESOLVED, "append", "EventTime")
    with rocksdb_state(spark):
        run_available(resolved, out + "/resolved")


def read_calls(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(calls, orphans) of the records so far, as ``pair_calls`` has them of the whole log.

    Lines that still wait in state are in neither."""
    whole = spark.read.parquet(out + "/records").drop("epoch")
    paired = whole.where(F.col("start").isNotNull() & F.col("done").isNotNull())
    resolved = spark.read.schema(RESOLVED).parquet(out + "/resolved/data")
    lone = resolved.select(F.explode(F.array("start_record", "done_record")).alias("json")) \
        .where("json IS NOT NULL").select(F.from_json("json", paired.schema).alias("r")) \
        .select("r.*")
    return split_calls(paired.unionByName(lone))
