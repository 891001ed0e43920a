import contextlib
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from canopy.operators.registry import RECORD_FIELDS
from canopy.sources import fixtures as FX
from canopy.sources.logs import ingest_log
from canopy.streaming import calls as C
from canopy.streaming import streams as S
from canopy.streaming.registry_table import RegistryTable

SF = "/root/testdata/sf0.001"


def _drift(spark, parts, timeout=None):
    """Each part arrives after the one before was read; both streams restart in between."""
    base = S.scratch(spark, "drift-multi")
    for part in parts:
        part.write.mode("append").parquet(base + "/src")
        stream = S.file_stream(spark, base + "/src", part.schema)
        S.advance_stream_drift(stream, base + "/out", timeout)
    cols = ["req_id", "session_no", "expected", "violation", "message"]
    return base, sorted(map(tuple, S.read_stream_drift(spark, base + "/out").select(
        *cols).collect()))


def _batch_drift(rows, timeout=None):
    from canopy.operators import drift as D
    return sorted(map(tuple, D.check_drift(rows, timeout).select(
        "req_id", "session_no", "expected", "violation", "message").collect()))


def test_stream_drift_across_restarts_equals_batch(spark):
    r = FX.results_seq(spark, SF)
    parts = [r.where(c) for c in ("year(ts) < 1994", "year(ts) between 1994 and 1996",
                                  "year(ts) > 1996")]
    base, got = _drift(spark, parts)
    assert got == _batch_drift(r)
    # the state function saw one row per session, number and key of a batch, not one per row
    firsts = spark.read.parquet(base + "/out/firsts/*")
    assert firsts.count() == firsts.select(*S.FIRSTS).distinct().count()
    # a trigger without new files changes nothing
    S.advance_stream_drift(S.file_stream(spark, base + "/src", r.schema), base + "/out")
    assert S.read_stream_drift(spark, base + "/out").count() == len(got)


def test_stream_drift_sessions_end_by_time(spark):
    def row(i, session, at, key, h, reset=0):
        ts = None if at is None else datetime(2024, 1, 1) + timedelta(seconds=at)
        return (i, session, ts, key, h, reset)

    schema = ("req_id long, session_id long, ts timestamp_ntz, intent_key string, "
              "content_hash string, is_reset int")
    parts = [
        [row(1, 1, 0, "k", "a"), row(2, 1, 50, "k", "b"), row(3, 2, 55, "k", "a"),
         row(4, None, 56, None, "x"), row(5, 1, 57, "j", "")],
        [row(6, 1, 156, "k", "c"), row(7, 2, 200, "k", "b"), row(8, None, 157, None, "y"),
         row(9, 1, 158, "j", "d"), row(10, 1, 300, "k", "e")],
        [row(11, 1, 301, "k", "f"), row(12, 2, 302, "k", "z", 1), row(13, 2, 303, "k", "b"),
         row(14, 9, 304, "k", None), row(15, 9, 305, "k", "q")],
    ]
    frames = [spark.createDataFrame(p, schema) for p in parts]
    for timeout in (100, 145):
        want = _batch_drift(frames[0].unionByName(frames[1]).unionByName(frames[2]), timeout)
        assert _drift(spark, frames, timeout)[1] == want
    assert any(r[1] > 1 for r in want)


def _events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, "
                                       "event_type string, value double, props string")


def _event(i, seconds, user=1):
    return (i, datetime(2024, 1, 1) + timedelta(seconds=seconds), user, "error" if i % 3 else "x",
            0.0, '{"k": %d}' % i)


@pytest.mark.parametrize("kind", ["tumbling", "sliding", "session"])
def test_each_event_is_in_closed_windows_in_open_ones_or_late(spark, kind):
    base = S.scratch(spark, "windows-" + kind)
    per_event = 3 if kind == "sliding" else 1
    batches = [[_event(i, 60 * i) for i in range(30)],
               # at 5 and 6 minutes all windows have closed, at 28 minutes none has
               [_event(100, 9_000), _event(101, 28 * 60)],
               [_event(102, 300), _event(103, 360), _event(104, 9_001), _event(105, 7_000)]]
    seen = 0
    for rows in batches:
        frame = _events(spark, rows)
        frame.coalesce(1).write.mode("append").parquet(base + "/src")
        S.advance_metrics(S.file_stream(spark, base + "/src", frame.schema), base + "/out", kind)
        seen += len(rows)
    late = {r.event_id for r in spark.read.parquet(base + "/out/late").collect()}
    whole = {102, 103, 105} if kind != "session" else {102, 103}
    assert late == whole
    src = spark.read.parquet(base + "/src")
    S.closing_sentinel(src, kind).write.mode("append").parquet(base + "/src")
    S.advance_metrics(S.file_stream(spark, base + "/src", src.schema), base + "/out", kind)
    closed = spark.read.parquet(base + "/out/data")
    # an event that is late for some of its sliding windows counts in the others
    assert closed.agg(F.sum("calls")).first()[0] == (seen - len(late)) * per_event
    want = {"tumbling": S.tumbling_metrics, "sliding": S.sliding_metrics,
            "session": S.session_metrics}[kind](src.where(~F.col("event_id").isin(list(late))))
    assert closed.exceptAll(want.select(*closed.columns)).count() == 0


def test_state_holds_open_windows_only(spark):
    base = S.scratch(spark, "bounded")
    held = []
    for part in range(6):
        frame = _events(spark, [_event(part * 200 + i, 30 * (part * 200 + i)) for i in range(200)])
        frame.write.mode("append").parquet(base + "/src")
        progress = S.advance_metrics(S.file_stream(spark, base + "/src", frame.schema),
                                     base + "/out", "tumbling")
        held.append(progress[-1]["stateOperators"][0]["numRowsTotal"])
    # 20 windows a batch, of which those behind the 10 minute watermark are gone
    assert max(held) <= 4
    assert spark.read.parquet(base + "/out/data").count() >= 6 * 20 - 4


def test_log_stream_survives_a_forced_replay(spark):
    import shutil

    base = S.scratch(spark, "replay")
    lines = FX.log_lines(spark, SF).repartition(4)

    def advance():
        C.advance_log(S.file_stream(spark, base + "/src", "value string", fmt="text")
                      .withColumnRenamed("value", "line"), base + "/log")

    for part in lines.randomSplit([1.0, 1.0], 3):
        part.write.mode("append").text(base + "/src")
        advance()
    commits = sorted(f for f in os.listdir(base + "/log/_ingest/commits") if f.isdigit())
    assert len(commits) == 2
    # as after a failure between the sinks and the commit: the batch runs again
    os.remove(f"{base}/log/_ingest/commits/{commits[-1]}")
    with contextlib.suppress(FileNotFoundError):
        os.remove(f"{base}/log/_ingest/commits/.{commits[-1]}.crc")
    shutil.rmtree(f"{base}/log/corrupt/epoch={commits[-1]}")
    advance()
    log, corrupt = C.read_log(spark, base + "/log")
    want, want_corrupt = ingest_log(lines)
    assert log.count() == want.count() and corrupt.count() == want_corrupt.count() > 0
    assert log.select(*want.columns).exceptAll(want).count() == 0
    assert corrupt.exceptAll(want_corrupt).count() == 0


def _sections(spark, rows):
    fields = ", ".join(f"{c} string" for c in RECORD_FIELDS)
    n = len(RECORD_FIELDS) - 1
    return spark.createDataFrame(
        [(ts, i, 1, h, *[f"{h}-{ts}-{i}"] * n) for ts, i, h in rows],
        "ts long, req_id long, attempt int, " + fields)


def test_registry_table_rewrites_touched_buckets_only(spark, tmp_path):
    t = RegistryTable(spark, str(tmp_path / "reg"), buckets=8)
    first = _sections(spark, [(1, i, f"h{i}") for i in range(40)])
    assert t.read() is None
    assert t.merge(first, 0) == list(range(8))
    before = t.manifest()
    touched = t.merge(_sections(spark, [(2, 99, "h3"), (0, 98, "h4"), (2, 97, "h3")]), 1)
    after = t.manifest()
    assert 1 <= len(touched) <= 2
    assert {b for b in before if before[b] != after[b]} == {str(b) for b in touched}
    rows = {r.content_hash: r for r in t.read().collect()}
    assert len(rows) == 40
    assert rows["h3"].req_id == 99 and rows["h4"].req_id == 4
    # the same batch again, as after a failure before its commit
    assert t.merge(_sections(spark, [(2, 99, "h3"), (0, 98, "h4"), (2, 97, "h3")]), 1) == touched
    assert sorted(map(tuple, t.read().collect())) == sorted(map(tuple, rows.values()))


def test_registry_table_removes_superseded_folders(spark, tmp_path):
    t = RegistryTable(spark, str(tmp_path / "reg"), buckets=2)
    for epoch in range(5):
        t.merge(_sections(spark, [(epoch, i, f"h{i}") for i in range(10)]), epoch)
    assert len(os.listdir(tmp_path / "reg" / "data")) == 2
    assert len([f for f in os.listdir(tmp_path / "reg" / "manifests") if f[0] != "."]) == 2
    assert t.read().where("ts = 4").count() == 10
    assert t.merge(_sections(spark, []), 5) == []
    assert t.read().count() == 10


def test_an_unfinished_version_is_not_read(spark, tmp_path):
    t = RegistryTable(spark, str(tmp_path / "reg"), buckets=2)
    t.merge(_sections(spark, [(1, 1, "h1")]), 0)
    _sections(spark, [(9, 9, "h9")]).write.parquet(str(tmp_path / "reg/data/epoch=000000000001/bucket=0"))
    assert [r.content_hash for r in t.read().collect()] == ["h1"]
    t.merge(_sections(spark, [(2, 2, "h2")]), 1)
    assert {r.content_hash for r in t.read().collect()} == {"h1", "h2"}


def test_sessions_of_one_group_share_a_call_of_the_state_function(spark, monkeypatch):
    monkeypatch.setattr(S, "SESSION_GROUPS", 1)
    test_stream_drift_across_restarts_equals_batch(spark)
    test_stream_drift_sessions_end_by_time(spark)
