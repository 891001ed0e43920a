"""Prompt binding and report text, cases from the audited system's tests."""
import pytest
from pyspark.sql import functions as F

from canopy.operators import canonical as C
from canopy.operators import registry as G

CASES = [
    ("add", "Total", "PURE_FUNCTION", "javascript", "Function name: total"),
    ("validate", "EvenNumber", "PREDICATE", "javascript", "Function name: isEvenNumber"),
    ("transform", "UserDto", "TRANSFORMER", "javascript", "Function name: toUserDto"),
    ("save", "User", "SIDE_EFFECT_OP", "javascript", "Function name: saveUser"),
    ("define", "User", "DATA_CONTRACT", "javascript", "Type name: User"),
    ("define", "AuthToken", "DATA_CONTRACT", "python", "Type name: AuthToken"),
    ("save", "User", "SIDE_EFFECT_OP", "python", "Function name: save_user"),
    ("add", "Total", "PURE_FUNCTION", "python", "Function name: total"),
]


@pytest.mark.parametrize("case", CASES, ids=[f"{c[2]}-{c[3]}-{c[1]}" for c in CASES])
def test_user_message_names(spark, case):
    verb, noun, t, lang, expect = case
    df = spark.createDataFrame([(1, verb, noun, t, lang)],
                               "req_id long, verb string, noun string, intent_type string, language string")
    msg = C.bind_prompts(df).first().user_message
    assert expect in msg
    assert f"Language target: {lang}" in msg and f"Intent type: {t}" in msg


def test_full_user_message_text(spark):
    df = spark.createDataFrame([(1, "add", "Total", "PURE_FUNCTION", "javascript")],
                               "req_id long, verb string, noun string, intent_type string, language string")
    assert C.bind_prompts(df).first().user_message == (
        "Language target: javascript\nIntent type: PURE_FUNCTION\nCanonical verb: add\n"
        "Canonical noun: Total\nFunction name: total\n"
        "Generate the function following the exact template for PURE_FUNCTION.")


def _result(spark, **kw):
    cols = ["status", "content_hash", "intent_classification", "signature", "implementation",
            "invariants", "test_oracle", "dependencies", "unclear_dimension", "clarifying_question",
            "assumed_interpretation"]
    row = tuple(kw.get(c) for c in cols)
    return spark.createDataFrame([row], ", ".join(f"{c} string" for c in cols))


def test_report_with_and_without_dependencies(spark):
    base = dict(status="ok", content_hash="abcdef1234567890", intent_classification="type: X",
                signature="sig", implementation="code", invariants="inv", test_oracle="assert(1)")
    text = G.report_text(_result(spark, **base)).first().report
    assert text == ("=== Intent Classification ===\ntype: X\n\n=== Signature ===\nsig\n\n"
                    "=== Implementation ===\ncode\n\n=== Invariants ===\ninv\n\n"
                    "=== Test Oracle ===\nassert(1)\n\n[Hash: abcdef1234567890]")
    with_deps = G.report_text(_result(spark, dependencies="axios", **base)).first().report
    assert "\n\n=== Dependencies ===\naxios\n\n[Hash: " in with_deps


def test_report_ambiguity_and_error(spark):
    amb = G.report_text(_result(spark, status="ambiguity", unclear_dimension="u",
                                clarifying_question="q", assumed_interpretation="a")).first().report
    assert amb == "AMBIGUITY DETECTED\n  Unclear: u\n  Question: q\n  Assumed: a"
    err = G.report_text(_result(spark, status="failed")).first().report
    assert err == "ERROR: No sections available"
