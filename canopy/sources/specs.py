"""Spec ingest (#2): YAML / JSON spec rows -> classified rows or an error.

JSON rows are parsed on the JVM (``try_parse_json``).  YAML has no Spark
reader, so YAML rows are turned into JSON text by PyYAML inside
``mapInPandas`` (Arrow batches, one partition at a time) and then join the
same JVM-side validation.  No synonym lookup; confidence is always HIGH.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.functions import dims
from canopy.functions import text as T


def yaml_value(body: str):
    """The value of a YAML text; raises ValueError with the loader's text if there is none."""
    import yaml
    # the C loader (libyaml) accepts the same safe subset, much faster
    try:
        return yaml.load(body.strip(), Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except yaml.YAMLError:
        try:  # the pure-Python loader gives the audited system's exact error text
            return yaml.load(body.strip(), Loader=yaml.SafeLoader)
        except yaml.YAMLError as exc:
            raise ValueError(str(exc)) from exc


def _parse(body: str) -> tuple[str | None, str | None]:
    """(JSON text, error) of one body: JSON that the JVM refuses (a repeated key: the last
    one counts), else YAML.  A scalar that YAML cannot build, such as an impossible date,
    is an error of its row."""
    if body.strip()[:1] in ("{", "["):
        try:
            return json.dumps(json.loads(body)), None
        except ValueError:
            return None, "Invalid spec format: invalid JSON"
    try:
        obj = yaml_value(body)
    except ValueError as exc:
        return None, f"Invalid spec format: {exc}"
    if not isinstance(obj, dict):
        return None, "Invalid spec format: expected a mapping"
    return json.dumps(obj, default=str), None


def _yaml_to_json(batches):
    for pdf in batches:
        seen: dict[str, tuple[str | None, str | None]] = {}
        out = []
        for body in pdf["body"]:
            r = seen.get(body)
            if r is None:
                r = seen[body] = _parse(body or "")
            out.append(r)
        yield pd.DataFrame({"spec_id": pdf["spec_id"], "body": pdf["body"],
                            "parsed_json": [o[0] for o in out], "parse_error": [o[1] for o in out]})


def _is_json(body: F.Column) -> F.Column:
    s = T.py_strip(body)
    return s.startswith("{") | s.startswith("[")


def ingest_specs(spec_text: DataFrame) -> DataFrame:
    """spec rows -> (spec_id, source, intent_type, verb, noun, language, confidence, error)."""
    rows = spec_text.select("spec_id", "body")
    is_json = F.coalesce(_is_json(F.col("body")), F.lit(False))
    on_jvm = is_json & F.try_parse_json(F.col("body")).isNotNull()
    source = F.when(is_json, "json_spec").otherwise("yaml_spec")
    js = rows.where(on_jvm).select("spec_id", "body", F.col("body").alias("parsed_json"),
                                   F.lit(None).cast("string").alias("parse_error"))
    kind = rows.schema["spec_id"].dataType.simpleString()
    rest = rows.where(~on_jvm).mapInPandas(
        _yaml_to_json, f"spec_id {kind}, body string, parsed_json string, parse_error string")
    return validate_spec_rows(js.unionByName(rest).withColumn("source", source))


def validate_spec_rows(p: DataFrame) -> DataFrame:
    v = F.try_parse_json("parsed_json")
    is_obj = F.schema_of_variant(v).startswith("OBJECT")
    keys_present = lambda k: F.when(is_obj, F.try_variant_get(v, f"$.{k}", "variant").isNotNull()).otherwise(
        F.array_contains(F.coalesce(F.try_variant_get(v, "$", "array<string>"),
                                    F.array().cast("array<string>")), k))
    get = lambda k: F.when(is_obj, F.try_variant_get(v, f"$.{k}", "string"))
    intent = F.lower(T.py_strip(get("intent")))
    lang = F.lower(T.py_strip(get("language")))
    t_expr = None
    for name, t in dims.SPEC_INTENTS.items():
        t_expr = F.when(intent == name, t) if t_expr is None else t_expr.when(intent == name, t)
    missing = None
    for k in dims.SPEC_REQUIRED_FIELDS:
        m = F.when(~keys_present(k), F.lit(f"Missing required field: {k}"))
        missing = m if missing is None else F.coalesce(missing, m)
    # a field that is there has to be text: a null, number, list or mapping is an error
    untyped = F.coalesce(*[
        F.when(~F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
                           == "STRING", F.lit(False)), F.lit(f"Field must be text: {k}"))
        for k in dims.SPEC_REQUIRED_FIELDS])
    error = (F.when(F.col("parse_error").isNotNull(), F.col("parse_error"))
             .when(missing.isNotNull(), missing)
             .when(untyped.isNotNull(), untyped)
             .when(t_expr.isNull(), F.concat(F.lit("Unknown intent type: "), intent))
             .when(~lang.isin(dims.LANGUAGES), F.concat(F.lit("Unsupported language: "), lang)))
    ok = error.isNull()
    return p.select(
        "spec_id", "source",
        F.when(ok, t_expr).alias("intent_type"), F.when(ok, get("verb")).alias("verb"),
        F.when(ok, get("noun")).alias("noun"), F.when(ok, lang).alias("language"),
        F.when(ok, F.lit("HIGH")).alias("confidence"), error.alias("error"))
