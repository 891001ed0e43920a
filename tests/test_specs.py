from canopy.sources.specs import ingest_specs


def test_yaml_and_json_specs(spark):
    rows = [(0, "intent: pure_function\nverb: add\nnoun: Total\nlanguage: javascript"),
            (1, '{"intent": "predicate", "verb": "validate", "noun": "EvenNumber", "language": "javascript"}'),
            (2, "intent: [unclosed"), (3, "- a\n- b"), (4, "intent: Unknown_Type\nverb: x\nnoun: y\nlanguage: go")]
    df = spark.createDataFrame(rows, "spec_id long, body string")
    got = {r.spec_id: r for r in ingest_specs(df).collect()}
    assert (got[0].intent_type, got[0].source, got[0].confidence) == ("PURE_FUNCTION", "yaml_spec", "HIGH")
    assert (got[1].intent_type, got[1].source) == ("PREDICATE", "json_spec")
    assert got[2].error.startswith("Invalid spec format: ")
    assert got[3].error == "Invalid spec format: expected a mapping"
    assert got[4].error == "Unknown intent type: unknown_type"
