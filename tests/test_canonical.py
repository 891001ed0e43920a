"""Literal phrases with the canonical form worked out from the audited rules."""
import pytest
from pyspark.sql import functions as F

from canopy.operators import canonical as C
from canopy.functions import text as T

# idx, text, verb, noun, matches, confidence, javascript name
A1 = [
    (0, "write add function", "add", "Total", "PURE_FUNCTION", "HIGH", "total"),
    (1, "make a sum method", "add", "Total", "PURE_FUNCTION,CLASS_METHOD", "MEDIUM", "total"),
    (2, "create a function to add two numbers", "add", "Total", "PURE_FUNCTION", "HIGH", "total"),
    (3, "combine two numbers", "add", "Total", "PURE_FUNCTION", "HIGH", "total"),
    (4, "I need addition", "add", "Addition", "PURE_FUNCTION", "HIGH", "addition"),
    (5, "subtract two numbers", "subtract", "Difference", "PURE_FUNCTION", "HIGH", "difference"),
    (6, "remove from list", "subtract", "Remove", "PURE_FUNCTION", "HIGH", "remove"),
    (7, "check if even", "validate", "Even", "PREDICATE", "HIGH", "isEven"),
    (8, "is it a valid email", "unknown", "Valid", "PREDICATE", "HIGH", "isValid"),
    (9, "convert user to DTO", "transform", "User", "TRANSFORMER", "HIGH", "toUser"),
    (10, "transform and save data", "transform", "And", "TRANSFORMER", "HIGH", "toAnd"),
    (11, "count active users", "unknown", "Count", "AGGREGATOR", "HIGH", "reduceCount"),
    (12, "sum all order totals", "add", "All", "PURE_FUNCTION", "HIGH", "all"),
    (13, "filter items by status", "unknown", "Filter", "AGGREGATOR", "HIGH", "reduceFilter"),
    (14, "save user to database", "save", "User", "SIDE_EFFECT_OP", "HIGH", "saveUser"),
    (15, "delete the record", "unknown", "Delete", "DATA_CONTRACT", "HIGH", "Delete"),
    (16, "fetch user profile", "fetch", "User", "ASYNC_OPERATION", "HIGH", "fetchUser"),
    (17, "stream events from queue", "unknown", "Stream", "ASYNC_OPERATION", "HIGH", "unknownStream"),
    (18, "define a User type", "define", "User", "DATA_CONTRACT", "HIGH", "User"),
    (19, "schema for AuthToken", "define", "Authtoken", "DATA_CONTRACT", "HIGH", "Authtoken"),
    (20, "frobnicate the data", "unknown", "Frobnicate", "", "LOW", "frobnicate"),
    (21, "the target address", "add", "Target", "PURE_FUNCTION", "HIGH", "target"),
    (22, "is the data fetch complete", "fetch", "Data", "PREDICATE,ASYNC_OPERATION", "MEDIUM", "isData"),
    (23, "calculate the total amount", "calculate", "Total", "PURE_FUNCTION", "HIGH", "total"),
    (24, "ａｄｄ two numbers", "add", "Total", "PURE_FUNCTION", "HIGH", "total"),
    (27, "add orders together", "add", "Orders", "PURE_FUNCTION,AGGREGATOR", "MEDIUM", "orders"),
]


@pytest.fixture(scope="module")
def classified(spark):
    rows = [(i, 1, None, t, "js") for i, t, *_ in A1]
    raw = spark.createDataFrame(rows, "req_id long, session_id long, ts timestamp, text string, alias string")
    out = C.classify_requests(raw).withColumn(
        "name", T.function_name(F.col("intent_type"), F.col("verb"), F.col("noun"), F.col("language")))
    return {r.req_id: r for r in out.collect()}


@pytest.mark.parametrize("row", A1, ids=[str(r[0]) for r in A1])
def test_literal_phrase(classified, row):
    idx, _, verb, noun, matches, conf, name = row
    r = classified[idx]
    assert (r.verb, r.noun, ",".join(r.matches), r.confidence, r.name) == (verb, noun, matches, conf, name)


def test_intent_key_check_value(spark):
    df = spark.range(1).select(T.intent_key(F.lit("add"), F.lit("Total"), F.lit("javascript"),
                                            F.lit("PURE_FUNCTION")).alias("k"))
    assert df.first().k == "21647c75198dffd8f6db438eaee64e2c"


def test_ingest_rejects(spark):
    from canopy.sources.ingest import ingest_requests
    raw = spark.createDataFrame(
        [(1, 1, None, "ab", "js"), (2, 1, None, "write add", "rust"), (3, 1, None, "  add  ", " PY "),
         (4, 1, None, "intent: pure_function verb: add", "go")],
        "req_id long, session_id long, ts timestamp, text string, alias string")
    got = {r.req_id: (r.status, r.language, r.source) for r in ingest_requests(raw).collect()}
    assert got[1] == ("Intent too short", "javascript", "freetext")
    assert got[2] == ("Unsupported language: rust", None, "freetext")
    assert got[3] == ("ok", "python", "freetext")
    assert got[4] == ("ok", "go", "yaml_spec")


def test_python_snake_case(spark):
    df = spark.createDataFrame([("SIDE_EFFECT_OP", "save", "UserRecord", "python"),
                                ("DATA_CONTRACT", "define", "AuthToken", "python")],
                               "t string, v string, n string, l string")
    got = [r.x for r in df.select(T.function_name(F.col("t"), F.col("v"), F.col("n"), F.col("l")).alias("x")).collect()]
    assert got == ["save_user_record", "AuthToken"]


def test_gate_texts(spark, classified):
    r = classified[1]
    assert r.confidence == "MEDIUM"


def test_shared_texts_are_computed_once_per_row(spark):
    from canopy.operators.canonical import split_requests
    from canopy.sources.ingest import ingest_requests
    rows = spark.createDataFrame([(1, " Add a, Check b ", " JS ")],
                                 "req_id long, text string, alias string")

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    assert plan(split_requests(rows)).count("lower(") == 1
    assert plan(ingest_requests(rows)).count("lower(") == 2  # of the alias and of the text
    assert [r.sub_text for r in split_requests(rows).orderBy("pos").collect()] == \
        ["Add a", "Check b"]
    assert ingest_requests(rows).first().language == "javascript"
