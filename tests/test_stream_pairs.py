"""Calls paired by keyed state equal the batch operator's, whatever the order of arrival."""

import json

from canopy.operators import logs as L
from canopy.sources.logs import ingest_log
from canopy.streaming import calls as C
from canopy.streaming import streams as S

CALLS = ["trace_id", "span_id", "start_ts", "end_ts", "tokens_in", "tokens_out", "latency_ms",
         "model"]


def line(event, span, at, **more):
    return json.dumps({"level": "info", "timestamp": f"2024-05-01T{at}.000000Z", "event": event,
                       "trace_id": "t", "span_id": span, **more})


def start(span, at, model="m"):
    return line("llm_call_start", span, at, model=model)


def complete(span, at, tokens=3):
    return line("llm_call_complete", span, at, tokens_in=tokens, tokens_out=4, latency_ms=1.5)


ARRIVALS = [
    [start("short", "08:00:00"), complete("short", "08:00:30"),
     start("long", "08:00:00"), start("days", "00:00:00"), start("failed", "08:00:00"),
     complete("no-start", "08:00:00"), start("twice", "08:00:05"),
     # the later line comes first
     start("early", "08:00:05", "second"), complete("early", "08:00:07", 7),
     start("state", "08:00:05", "second"), complete("given-up", "08:00:06")],
    [complete("long", "08:10:01"), complete("days", "23:59:59"), complete("days", "23:59:59"),
     complete("twice", "08:00:09", 9), start("early", "08:00:04", "first"),
     complete("early", "08:00:06", 6), start("state", "08:00:04", "first"),
     complete("twice", "08:00:08", 8)],
    # far behind the clock
    [start("late", "09:00:00"), complete("late", "09:00:01"), complete("state", "08:00:09"),
     start("given-up", "08:00:01"), "no json", start("new", "23:59:59")],
]


def run(spark, arrivals, patience, close=True):
    base = S.scratch(spark, "pairs")
    schema = ingest_log(spark.createDataFrame([("",)], "line string"))[0].schema

    def pair(close=False):
        C.advance_calls(spark.readStream.schema(schema).parquet(base + "/log/log/*"),
                        base + "/calls", patience, close)

    for rows in arrivals:
        spark.createDataFrame([(x,) for x in rows], "line string").coalesce(1) \
            .write.mode("append").text(base + "/src")
        C.advance_log(S.file_stream(spark, base + "/src", "value string", fmt="text")
                      .withColumnRenamed("value", "line"), base + "/log")
        pair()
    if close:
        pair(True)
    return base


def same_as_batch(spark, base, arrivals):
    lines = spark.createDataFrame([(x,) for rows in arrivals for x in rows], "line string")
    want, want_orphans = L.pair_calls(ingest_log(lines)[0])
    calls, orphans = C.read_calls(spark, base + "/calls")
    key = ["trace_id", "span_id", "kind"]
    assert sorted(map(str, calls.select(*CALLS).collect())) == sorted(
        map(str, want.select(*CALLS).collect()))
    assert sorted(map(tuple, orphans.select(*key).collect())) == sorted(
        map(tuple, want_orphans.select(*key).collect()))
    return {r.span_id: r for r in calls.collect()}


def test_patient_state(spark):
    calls = same_as_batch(spark, run(spark, ARRIVALS, 10 * 86_400), ARRIVALS)
    assert calls["early"].model == "first" and calls["early"].tokens_in == 6
    assert calls["state"].model == "first" and calls["twice"].tokens_in == 8
    assert {"days", "long", "late", "given-up"} <= set(calls)


def test_lines_given_up_by_a_timer_still_meet_when_read(spark):
    base = run(spark, ARRIVALS, 60)
    same_as_batch(spark, base, ARRIVALS)


def test_open_calls_wait_in_state_and_resolved_ones_leave_it(spark):
    base = run(spark, ARRIVALS[:1], 10 * 86_400, close=False)
    calls, orphans = C.read_calls(spark, base + "/calls")
    assert {r.span_id for r in calls.collect()} == {"short", "early"}
    assert orphans.count() == 0  # seven lines wait, none is given up
    # only lines without a partner in their batch reach the state function
    assert spark.read.schema(C.OPEN).parquet(base + "/calls/open/*").count() == 7


def test_calls_of_one_group_share_a_call_of_the_state_function(spark, monkeypatch):
    for groups, patience in ((1, 60), (3, 86_400)):
        monkeypatch.setattr(C, "CALL_GROUPS", groups)
        same_as_batch(spark, run(spark, ARRIVALS, patience), ARRIVALS)


def test_stand_in_log_files_hold_a_bounded_number_of_lines(spark, monkeypatch):
    from pyspark.sql import functions as F

    from canopy.plans import catalog
    from canopy.sources import fixtures as FX
    monkeypatch.setattr(catalog, "LINES_PER_FILE", 500)
    base = catalog._stream_log(spark, "/root/testdata/sf0.001")
    lines = spark.read.text(base + "/src")
    assert max(r["count"] for r in lines.groupBy(F.input_file_name()).count().collect()) <= 500
    assert lines.count() == FX.log_lines(spark, "/root/testdata/sf0.001").count()


def test_a_line_is_parsed_once(spark):
    lines = spark.createDataFrame([(start("a", "08:00:00"),)], "line string")
    for df in ingest_log(lines):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == 1
