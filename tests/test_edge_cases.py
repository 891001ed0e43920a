"""Rows that used to vanish, crash a job or hit a cap."""
import datetime as dt
import json

from pyspark.sql import functions as F

from canopy.operators import drift as D
from canopy.operators import logs as L
from canopy.operators import projects as P
from canopy.operators import replies as R
from canopy.sources.ingest import ingest_requests, split_ingested
from canopy.sources.logs import ingest_log
from canopy.sources.specs import ingest_specs
from canopy.streaming import streams as S


def test_null_alias_and_text_are_rejected(spark):
    raw = spark.createDataFrame([(1, "add two numbers", "js"), (2, "add two numbers", None),
                                 (3, None, "js"), (4, "ab", "js")],
                                "req_id long, text string, alias string")
    ok, rejects = split_ingested(ingest_requests(raw))
    assert [r.req_id for r in ok.collect()] == [1]
    assert {r.req_id: r.status for r in rejects.collect()} == {
        2: "Unsupported language: None", 3: "Intent too short", 4: "Intent too short"}


def test_drift_keeps_null_keys_and_ignores_replies_without_hash(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(1, 7, day, "k", "", 0), (2, 7, day, "k", "h1", 0), (3, 7, day, "k", "h2", 0),
            (4, None, day, "k", "h1", 0), (5, 7, None, "k", "h1", 0), (6, 7, day, "k", None, 0)]
    df = spark.createDataFrame(rows, "req_id long, session_id long, ts timestamp, "
                               "intent_key string, content_hash string, is_reset int")
    got = {r.req_id: (r.expected, r.violation) for r in D.check_drift(df).collect()}
    assert got == {1: (None, False), 2: ("h1", False), 3: ("h1", True), 4: ("h1", False),
                   5: ("h1", False), 6: (None, False)}


def test_many_hashes_do_not_overflow(spark):
    rows = [("T", "go", p, f"h{i % 40 + (p == 3)}") for p in range(5) for i in range(200)]
    runs = spark.createDataFrame(rows, "type string, language string, phrasing int, "
                                 "content_hash string")
    got = [tuple(r) for r in D.synonym_stability(runs).collect()]
    assert got == [("T", "go", 3, 40, 4)]


def test_bad_log_lines_go_to_corrupt(spark):
    good = {"event": "llm_call_start", "timestamp": "2024-01-01T00:00:00Z", "trace_id": "t",
            "span_id": "s", "max_tokens": 5}
    lines = [json.dumps(x) for x in (good, good | {"timestamp": "not a time"},
                                     good | {"max_tokens": "lots"}, {"x": 1})] + ["{", "", None]
    log, corrupt = ingest_log(spark.createDataFrame([(x,) for x in lines], "line string"))
    assert (log.count(), corrupt.count()) == (1, 6)


def test_repeated_lines_count_once(spark):
    base = {"trace_id": "t", "span_id": "s", "timestamp": "2024-01-01T00:00:00Z"}
    start = json.dumps(base | {"event": "llm_call_start", "model": "m"})
    done = json.dumps(base | {"event": "llm_call_complete", "tokens_in": 5, "tokens_out": 5})
    log, _ = ingest_log(spark.createDataFrame([(x,) for x in (start, start, done, done)],
                                              "line string"))
    calls, orphans = L.pair_calls(log)
    assert [r.tokens_in for r in calls.collect()] == [5] and orphans.count() == 0


def test_spec_bodies_that_used_to_fail(spark):
    bodies = ["verb: 2024-99-99", '{"intent": "predicate", "verb": "a", "verb": "check", '
              '"noun": "N", "language": "go"}', None, "{broken"]
    rows = spark.createDataFrame(list(enumerate(bodies)), "spec_id long, body string")
    got = {r.spec_id: r for r in ingest_specs(rows).collect()}
    assert got[0].error == "Invalid spec format: month must be in 1..12"
    assert (got[1].verb, got[1].error) == ("check", None)
    assert got[2].error and got[3].error == "Invalid spec format: invalid JSON"


def test_levels_of_a_deep_chain_and_a_cycle(spark):
    nodes = spark.createDataFrame([(i,) for i in range(14)], "node long")
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, 10)] + [(11, 12), (12, 11)]
                                  + [(13, 99)], "src long, dst long")
    got = {r.node: (r.level, r.cyclic) for r in P.build_levels(nodes, edges).collect()}
    assert got == {**{i: (i, False) for i in range(10)}, 10: (0, False),
                   **{i: (None, True) for i in (11, 12, 13)}}


def test_first_error_among_many_functions(spark):
    spec = {"project": {"name": "p", "language": "go", "modules": [
        {"name": "a", "functions": ["f"] * 10_001 + [42]},
        {"name": "a", "functions": ["g"]}]}}
    df = spark.createDataFrame([(1, json.dumps(spec))], "project_id long, spec_json string")
    row = P.ingest_projects(df)["violations"].first()
    assert row.error == "modules[0].functions[10001] must be a string or mapping"


def test_yaml_project(spark):
    text = "project:\n  name: p\n  language: go\n  modules:\n    - name: m\n      functions: [f]\n"
    df = spark.createDataFrame([(1, text)], "project_id long, spec_json string")
    out = P.ingest_projects(df)
    assert out["violations"].count() == 0
    assert [(r.module, r.intent) for r in out["functions"].collect()] == [("m", "f")]


def test_all_parameter_lists_are_read(spark):
    df = spark.createDataFrame([("f = (userId) => ((x, y) => ({a, b}) => 1)",)], "t string")
    assert df.select(R.parameter_names(F.col("t"))).first()[0] == ["userId", "x", "y", "a", "b"]


def test_config_lock_counts_only_known_prompt_hashes_in_one_aggregate(spark):
    from canopy.operators.logs import config_lock_audit
    from canopy.functions import dims
    pins = (dims.PINNED_TEMPERATURE, dims.PINNED_MODEL, dims.PINNED_MAX_TOKENS)
    rows = [(s, f"{s}{i}", float(pins[0]), *pins[1:], h) for s, hs in (
        ("one", ["a", None]), ("two", ["a", "b", None]), ("none", [None])) for i, h in enumerate(hs)]
    out = config_lock_audit(spark.createDataFrame(
        rows, "session_id string, span_id string, temperature double, model string, "
              "max_tokens long, system_prompt_hash string"))
    assert [tuple(r) for r in out.collect()] == [("two", None, "system_prompt")]
    plan = out.select("*")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
