"""Structured Streaming forms of drift state (#34) and call metrics (#53); log ingest and call
pairing (#3, #47) are in ``calls``, the registry table (#5) in ``registry_table``.

Every stream reads files (the given parquet tables, or derived files written
to the shared checkpoint folder), keeps its state in the checkpoint location,
and writes its result to files; ``run_available`` drives a query with
``availableNow`` so tests and the batch checks can read the result back.
"""

from __future__ import annotations

import contextlib
import json
import os
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from canopy.session import ensure_checkpoint_dir, temporary


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "canopy-stream", f"{name}-{uuid.uuid4().hex[:12]}")


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                max_files: int | None = None) -> DataFrame:
    """Stream the files of ``path`` (a folder, or one file given as a glob)."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(jvm_path).isFile():
        d, f = os.path.split(path)
        return r.option("basePath", d).load(os.path.join(d, f[:-1] + "[" + f[-1] + "]"))
    return r.load(path)


def run_available(df: DataFrame, out: str, fmt: str = "parquet") -> list:
    """Append the result for all available input to ``out/data``, then stop; returns the
    progress reports of the micro-batches."""
    q = (df.writeStream.outputMode("append").option("checkpointLocation", out + "/_checkpoint")
         .format(fmt).option("path", out + "/data").trigger(availableNow=True).start())
    q.awaitTermination()
    return list(q.recentProgress)


def for_each_batch(df: DataFrame, out: str, work) -> None:
    """Run ``work(batch, epoch)`` on every micro-batch of the available input, then stop.  What
    a batch stores between its steps goes when it has written its results."""
    def one(batch: DataFrame, epoch: int) -> None:
        with temporary(batch.sparkSession):
            work(batch, epoch)

    q = (df.writeStream.foreachBatch(one).option("checkpointLocation", out)
         .trigger(availableNow=True).start())
    q.awaitTermination()


#: A row at the watermark itself counts as late, so the watermark stays behind the clock.
CLOCK_DELAY = "1 second"


def batch_clock(spark: SparkSession, path: str, epoch: int, latest_us: int | None
                ) -> tuple[int, int]:
    """(clock before this batch, clock after it): the largest event time seen, in microseconds.

    Each epoch's own figure is kept under ``path``, so a repeated batch gets the same answer.
    The clock never goes back, so what carries it is never late behind a watermark."""
    own = spark.range(1).select(F.lit(latest_us or 0).cast("long").alias("us"))
    own.coalesce(1).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    before = spark.read.parquet(path).where(F.col("epoch") < epoch).agg(F.max("us")).first()[0]
    return before or 0, max(before or 0, latest_us or 0)


# ---------------------------------------------------------------- #34 ----
#: Keyed state with maps and timers needs the RocksDB state store.  Its memory is outside the
#: JVM's heap and grows with the number of state partitions unless it is bounded as a whole.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
#: State partitions at most: they are fixed when a stream first runs, and each is a store of
#: its own with a Python worker per batch (about a second each), so the session's shuffle
#: partitions must not set their number.
STATE_PARTITIONS = 24
FIRSTS = ["batch", "session", "local_no", "key"]
DRIFT_OUT = "batch long, session string, local_no long, key string, session_no long, expected string"


@contextlib.contextmanager
def rocksdb_state(spark: SparkSession):
    """The session with ``STATE_CONF`` and few enough partitions, and as before afterwards."""
    partitions = "spark.sql.shuffle.partitions"
    wanted = STATE_CONF | {partitions: str(min(STATE_PARTITIONS, int(spark.conf.get(partitions))))}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _text_key(column: str) -> F.Column:
    """A column as text in which null differs from every value."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def reduce_drift_batches(results_stream: DataFrame, out: str,
                         timeout_seconds: float | None = None) -> None:
    """Per micro-batch: number the sessions inside the batch and keep one row per (session, its
    number, key): the first accepted hash.

    The batch's rows go to ``out/rows/batch=<id>``, the reduced ones to ``out/firsts``, one
    folder per batch; a repeated batch overwrites both.  Numbers start at 0 for the rows that
    go on with the session of the batch before."""
    from canopy.operators.drift import assign_sessions

    def reduce(batch: DataFrame, epoch: int) -> None:
        numbered = assign_sessions(batch, timeout_seconds)
        numbered = numbered.withColumnRenamed("session_no", "local_no") \
            .withColumn("session", _text_key("session_id")) \
            .withColumn("key", _text_key("intent_key"))
        path = f"{out}/rows/batch={epoch}"
        numbered.write.mode("overwrite").parquet(path)
        rows = batch.sparkSession.read.schema(numbered.schema).parquet(path)
        us = F.unix_micros(F.col("ts").cast("timestamp"))
        _, clock = batch_clock(batch.sparkSession, out + "/clock", epoch,
                               rows.agg(F.max(us)).first()[0])
        hashed = F.col("content_hash") != ""
        firsts = rows.groupBy("session", "local_no", "key").agg(
            F.min_by(F.when(hashed, F.col("content_hash")),
                     F.when(hashed, F.struct("ts", "req_id"))).alias("first"),
            F.min(us).alias("from_us"), F.max(us).alias("to_us"))
        firsts.select(F.lit(epoch).cast("long").alias("batch"), "*",
                      F.timestamp_micros(F.lit(clock)).alias("clock")).write.mode(
            "overwrite").parquet(f"{out}/firsts/epoch={epoch:012d}")

    for_each_batch(results_stream, out + "/_reduce", reduce)


FIRSTS_SCHEMA = ("batch long, session string, local_no long, key string, first string, "
                 "from_us long, to_us long, clock timestamp")


#: Groups that the sessions are dealt to.  One call of the state function serves a group, as
#: one per session costs far more than the work on it.
SESSION_GROUPS = 1024


class DriftState(StatefulProcessor):
    """State per group of sessions: a map from the session to its number, the time of its last
    row, the time (ms) at which its expectations end, and the expected hash of each intent key
    (JSON).  With a timeout a session's expectations end at (last row + timeout) once the
    watermark has passed it; the number stays.  One timer a group stands at or before the
    earliest such time."""

    def __init__(self, timeout_seconds: float | None = None):
        self.timeout_us = None if timeout_seconds is None else round(timeout_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sessions = handle.getMapState(
            "sessions", "session string", "session_no long, last_us long, due long, expected string")
        self.timer = handle.getValueState("timer", "due long")

    def handleInputRows(self, key, rows, timerValues):
        # one row per key of a session and batch
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(
            ["session", "batch", "local_no"])
        spans = pdf.groupby(["session", "batch", "local_no"], sort=False).agg(
            start=("from_us", "min"), end=("to_us", "max"), n=("key", "size"))
        names, firsts, at, out, dues = list(pdf["key"]), list(pdf["first"]), 0, [], []
        session, no, last, expected = None, 0, -1, {}
        for (name, batch, local), start, end, n in zip(
                spans.index, spans["start"], spans["end"], spans["n"], strict=True):
            if name != session:
                if session is not None:
                    dues.append(self._put(session, no, last, expected))
                session = name
                held = self.sessions.getValue((name,)) \
                    if self.sessions.containsKey((name,)) else (0, -1, -1, "{}")
                no, last, expected = held[0], held[1], json.loads(held[3])
            paused = (self.timeout_us is not None and local == 0 and last >= 0
                      and start == start and start - last >= self.timeout_us)
            if local > 0 or paused:
                no += 1
                expected = {}
            if end == end:  # not a session of rows without a time
                last = max(last, int(end))
            for k, first in zip(names[at:at + n], firsts[at:at + n], strict=True):
                if k not in expected and first is not None and first == first:
                    expected[k] = first
                out.append((batch, name, local, k, no, expected.get(k)))
            at += n
        dues.append(self._put(session, no, last, expected))
        self._wake(min((d for d in dues if d >= 0), default=None))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DRIFT_OUT.split(", ")])

    def _put(self, session: str, no: int, last: int, expected: dict) -> int:
        due = -1 if self.timeout_us is None or last < 0 else (last + self.timeout_us) // 1000 + 1
        self.sessions.updateValue((session,), (no, last, due, json.dumps(expected)))
        return due

    def _wake(self, due: int | None) -> None:
        before = self.timer.get()[0] if self.timer.exists() else None
        if due is None or (before is not None and before <= due):
            return
        if before is not None:
            self.handle.deleteTimer(before)
        self.handle.registerTimer(due)
        self.timer.update((due,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        self.timer.clear()  # this timer is gone
        held = [(k[0], v) for k, v in self.sessions.iterator() if v[2] >= 0]
        for session, (no, last, due, _) in held:
            if due <= now:
                self.sessions.updateValue((session,), (no, last, -1, "{}"))
        self._wake(min((v[2] for _, v in held if v[2] > now), default=None))
        yield pd.DataFrame([], columns=[c.split()[0] for c in DRIFT_OUT.split(", ")])

    def close(self) -> None:
        pass


def stream_drift(firsts_stream: DataFrame, timeout_seconds: float | None = None) -> DataFrame:
    """Expected hash per (batch, session, number, key) from the reduced rows of
    ``reduce_drift_batches``, by keyed state (``DriftState``)."""
    s = firsts_stream
    if timeout_seconds is not None:
        # the batches' clock never goes back, so no row is late and dropped
        s = s.withWatermark("clock", CLOCK_DELAY)
    s = s.withColumn(
        "session_group", F.pmod(F.xxhash64("session"), F.lit(SESSION_GROUPS)).cast("int"))
    return s.groupBy("session_group").transformWithStateInPandas(
        DriftState(timeout_seconds), DRIFT_OUT, "append",
        "None" if timeout_seconds is None else "EventTime")


def advance_stream_drift(results_stream: DataFrame, out: str,
                         timeout_seconds: float | None = None) -> None:
    """Take all results that have arrived through both streams, from their checkpoints under
    ``out``.  State holds one hash per key of each session, however many rows a session has."""
    spark = results_stream.sparkSession
    reduce_drift_batches(results_stream, out, timeout_seconds)
    firsts = spark.readStream.schema(FIRSTS_SCHEMA).parquet(out + "/firsts/*")
    with rocksdb_state(spark):
        run_available(stream_drift(firsts, timeout_seconds), out + "/expected")


def read_stream_drift(spark: SparkSession, out: str) -> DataFrame:
    """The results so far with session_no, expected, violation and message, as ``check_drift``
    has them if results arrived in time order."""
    from canopy.operators.drift import drift_verdicts
    rows = spark.read.parquet(out + "/rows").withColumn("batch", F.col("batch").cast("long"))
    expected = spark.read.schema(DRIFT_OUT).parquet(out + "/expected/data")
    return drift_verdicts(rows.join(expected, FIRSTS)).drop(*FIRSTS)


# ---------------------------------------------------------------- #53 ----
def _events(stream: DataFrame, watermark: str) -> DataFrame:
    return (stream.withColumn("ts", F.col("ts").cast("timestamp"))
            .withWatermark("ts", watermark)
            .withColumn("tokens", F.get_json_object("props", "$.k").try_cast("long"))
            .withColumn("is_error", (F.col("event_type") == "error").cast("int")))


def _metrics(g):
    return g.agg(F.count("*").alias("calls"), F.sum("is_error").alias("errors"),
                 F.sum("tokens").alias("tokens"))


def tumbling_metrics(events_stream: DataFrame, size: str = "5 minutes",
                     watermark: str = "10 minutes") -> DataFrame:
    e = _events(events_stream, watermark)
    return _metrics(e.groupBy(F.window("ts", size).alias("w"))).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        "calls", "errors", "tokens")


def sliding_metrics(events_stream: DataFrame, size: str = "15 minutes", slide: str = "5 minutes",
                    watermark: str = "10 minutes") -> DataFrame:
    e = _events(events_stream, watermark)
    return _metrics(e.groupBy(F.window("ts", size, slide).alias("w"))).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        "calls", "errors", "tokens")


def session_metrics(events_stream: DataFrame, gap: str = "30 minutes",
                    watermark: str = "10 minutes") -> DataFrame:
    e = _events(events_stream, watermark)
    return _metrics(e.groupBy("user_id", F.session_window("ts", gap).alias("w"))).select(
        "user_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        "calls", "errors", "tokens")


WINDOWS = {"tumbling": tumbling_metrics, "sliding": sliding_metrics, "session": session_metrics}
#: Seconds from an event to the end of the last window that may hold it.
REACH = {"tumbling": 5 * 60, "sliding": 15 * 60, "session": 30 * 60}


def advance_metrics(events_stream: DataFrame, out: str, kind: str,
                    watermark_seconds: int = 600) -> list:
    """Take all events that have arrived through the metrics of ``kind`` in append mode, and
    the late ones into a table of their own; returns the progress reports.

    ``out/data`` gets a window once the watermark (largest event time less
    ``watermark_seconds``) has passed its end; its state is dropped then.  An event of which
    every window had closed before its batch is counted in no window and goes to
    ``out/late``.  So each event is in closed windows, in open ones, or late.  Both queries
    go on from their checkpoints; call once per arrival, so that their batches agree."""
    late_us = watermark_seconds * 1_000_000

    def set_aside(batch: DataFrame, epoch: int) -> None:
        us = F.unix_micros(F.col("ts").cast("timestamp"))
        rows = batch.withColumn("__us", us)
        before, _ = batch_clock(batch.sparkSession, out + "/clock", epoch,
                                rows.agg(F.max("__us")).first()[0])
        mark = before - late_us
        if kind == "tumbling" or kind == "sliding":  # windows start at whole slides
            slide = 5 * 60 * 1_000_000
            end = F.floor(F.col("__us") / slide) * slide + REACH[kind] * 1_000_000
        else:
            end = F.col("__us") + REACH[kind] * 1_000_000
        late = rows.where(end <= F.floor(F.lit(mark) / 1000) * 1000) if before else \
            rows.where(F.lit(False))
        late.drop("__us").write.mode("overwrite").parquet(f"{out}/late/epoch={epoch}")

    for_each_batch(events_stream, out + "/_late", set_aside)
    return run_available(WINDOWS[kind](events_stream, watermark=f"{watermark_seconds} seconds"),
                         out)


def closing_sentinel(events: DataFrame, kind: str, watermark_seconds: int = 600) -> DataFrame:
    """One empty event so late that every window of ``events`` closes; its own stays open."""
    reach = REACH[kind] + watermark_seconds + 1
    last = events.agg((F.max("ts") + F.make_dt_interval(secs=F.lit(reach))).alias("ts"))
    return last.select(*[F.col("ts").cast(f.dataType).alias(f.name) if f.name == "ts"
                         else F.lit(None).cast(f.dataType).alias(f.name)
                         for f in events.schema.fields])
