"""Registered queries: name -> (Spark job, DuckDB oracle SQL or None).

Each Spark job reads the given tables (through ``canopy.sources.fixtures``)
so its work grows with them; column names match the oracle statement.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions import dims
from canopy.operators import canonical as C
from canopy.plans import oracle_sql as O
from canopy.sources import fixtures as FX
from canopy.sources.ingest import ingest_requests

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _classified(spark, sf_dir, src=FX.requests):
    return C.classify_requests(src(spark, sf_dir))


# ------------------------------------------------------------ requests ----
register("ingest_requests", f"""WITH {O.requests_cte()}, {O.ingested_cte()}
SELECT req_id, language, source, status FROM ingested""")(
    lambda spark, d: ingest_requests(FX.requests(spark, d))
    .select("req_id", "language", "source", "status"))

register("canonicalise", f"""WITH {O.requests_cte()}, {O.ingested_cte()}, {O.canonical_cte()}
SELECT req_id, verb, noun FROM canonical""")(
    lambda spark, d: _classified(spark, d).select("req_id", "verb", "noun"))

register("canonicalise_documents", f"""WITH {O.documents_cte()}, {O.ingested_cte()},
{O.canonical_cte()}
SELECT req_id, verb, noun FROM canonical""")(
    lambda spark, d: _classified(spark, d, FX.document_requests).select("req_id", "verb", "noun"))

_CLASSIFY_COLS = ["req_id", "language", "intent_type", "confidence", "intent_key"]
register("classify", f"""WITH {O.pipeline(O.requests_cte())}
SELECT req_id, language, intent_type, confidence, intent_key,
       array_to_string(matches, ',') AS matches FROM classified""")(
    lambda spark, d: _classified(spark, d).select(
        *_CLASSIFY_COLS, F.array_join("matches", ",").alias("matches")))

register("classify_documents", f"""WITH {O.pipeline(O.documents_cte())}
SELECT req_id, language, intent_type, confidence, intent_key,
       array_to_string(matches, ',') AS matches FROM classified""")(
    lambda spark, d: _classified(spark, d, FX.document_requests).select(
        *_CLASSIFY_COLS, F.array_join("matches", ",").alias("matches")))


def _gate_sql(src_cte: str) -> str:
    texts = ", ".join(f"{O.gate_text(c)} AS {c}" for c in dims.GATE_TEXTS["LOW"])
    return f"""WITH {O.pipeline(src_cte)}
SELECT req_id, CASE WHEN confidence = 'HIGH' THEN 'passed' ELSE 'quarantine' END AS route, {texts}
FROM classified"""


_GATE_COLS = ["req_id", "route", "unclear_dimension", "clarifying_question",
              "assumed_interpretation"]
register("gate", _gate_sql(O.requests_cte()))(
    lambda spark, d: C.gate(_classified(spark, d)).select(*_GATE_COLS))
register("gate_documents", _gate_sql(O.documents_cte()))(
    lambda spark, d: C.gate(_classified(spark, d, FX.document_requests)).select(*_GATE_COLS))

register("intent_rollup", f"""WITH {O.pipeline(O.requests_cte())}
SELECT language, intent_type, verb, confidence,
       GROUPING(language, intent_type, verb, confidence) AS gid, count(*) AS n
FROM classified GROUP BY CUBE (language, intent_type, verb, confidence)""")(
    lambda spark, d: C.intent_rollup(_classified(spark, d)))


def _passed(spark, d, src=FX.requests):
    return _classified(spark, d, src).where(F.col("confidence") == "HIGH")


register("quarantine_rate", f"""WITH {O.pipeline(O.requests_cte())}
SELECT confidence, language, count(*) AS n,
       sum(CASE WHEN confidence <> 'HIGH' THEN 1 ELSE 0 END)::BIGINT AS quarantined
FROM classified GROUP BY confidence, language""")(
    lambda spark, d: C.quarantine_rate(C.gate(_classified(spark, d))))

register("collapse_phrasings", f"""WITH {O.pipeline(O.requests_cte())}
SELECT intent_key, verb, noun, language, intent_type, count(*) AS phrasings,
       count(DISTINCT text) AS distinct_texts, arg_min(text, (ts, req_id)) AS representative,
       count(DISTINCT {O.function_name_sql()}) AS prompts
FROM classified WHERE confidence = 'HIGH'
GROUP BY intent_key, verb, noun, language, intent_type""")(
    lambda spark, d: C.collapse_phrasings(_passed(spark, d)))


def _user_message_sql() -> str:
    values = {"type": "intent_type", "verb": "verb", "noun": "noun", "language": "language",
              "name": O.function_name_sql()}
    return (f"CASE WHEN intent_type = 'DATA_CONTRACT' THEN "
            f"{O.fill(dims.CONTRACT_MESSAGE, **values)} "
            f"ELSE {O.fill(dims.FUNCTION_MESSAGE, **values)} END")


register("prompt_work", f"""WITH {O.pipeline(O.requests_cte())},
bound AS (SELECT *, {O.function_name_sql()} AS function_name, {_user_message_sql()} AS user_message
          FROM classified WHERE confidence = 'HIGH')
SELECT substr(sha256(user_message), 1, 16) AS prompt_id, intent_key, language, intent_type,
       function_name, user_message, count(*) AS n_requests
FROM bound GROUP BY ALL""")(
    lambda spark, d: C.build_prompt_work(_passed(spark, d))[0])

register("name_collisions", f"""WITH {O.pipeline(O.requests_cte())},
named AS (SELECT DISTINCT language, intent_key, {O.function_name_sql()} AS function_name
          FROM classified WHERE confidence = 'HIGH')
SELECT language, function_name, count(*) AS n_keys,
       string_agg(intent_key, ',' ORDER BY intent_key) AS intent_keys
FROM named GROUP BY language, function_name HAVING count(*) > 1""")(
    lambda spark, d: C.name_collisions(_passed(spark, d)))

_PAIRS = ", ".join(f"({O.q(a)}, {O.q(b)})" for i, a in enumerate(dims.TYPES)
                   for b in dims.TYPES[i + 1:])
register("rule_overlap", f"""WITH {O.pipeline(O.requests_cte())},
pairs AS (SELECT * FROM (VALUES {_PAIRS}) AS p(rule_1, rule_2))
SELECT rule_1, rule_2, count(*) AS n
FROM classified JOIN pairs ON list_contains(matches, rule_1) AND list_contains(matches, rule_2)
GROUP BY rule_1, rule_2""")(
    lambda spark, d: C.rule_overlap(_classified(spark, d)))

register("verb_gap_topk", f"""WITH {O.pipeline(O.documents_cte())}
SELECT regexp_extract(lower(norm_text), '[a-z]+') AS word, count(*) AS n
FROM canonical WHERE verb = 'unknown' AND regexp_extract(lower(norm_text), '[a-z]+') <> ''
GROUP BY 1 ORDER BY n DESC, word LIMIT 20""")(
    lambda spark, d: C.verb_gap_topk(C.canonicalise(
        ingest_requests(FX.document_requests(spark, d)).where(
            (F.col("status") == "ok") & (F.col("source") == "freetext")))))


def _taxonomy_sql(src_cte: str) -> str:
    return f"""WITH {src_cte}, {O.ingested_cte()},
{O.canonical_cte(name='can_old')}, {O.classified_cte('can_old', 'cls_old')},
{O.canonical_cte(table=C.VERB_SYNONYMS_V2, name='can_new')}, {O.classified_cte('can_new', 'cls_new')}
SELECT o.req_id, o.language, o.verb AS old_verb, n.verb AS new_verb, o.noun AS old_noun,
       n.noun AS new_noun, o.intent_type AS old_type, n.intent_type AS new_type,
       o.confidence AS old_confidence, n.confidence AS new_confidence
FROM cls_old o JOIN cls_new n USING (req_id)
WHERE o.verb <> n.verb OR o.noun <> n.noun OR o.intent_type <> n.intent_type
   OR o.confidence <> n.confidence"""


register("taxonomy_diff", _taxonomy_sql(O.requests_cte()))(
    lambda spark, d: C.taxonomy_diff(FX.requests(spark, d)))
register("taxonomy_diff_documents", _taxonomy_sql(O.documents_cte()))(
    lambda spark, d: C.taxonomy_diff(FX.document_requests(spark, d)))


def _split_sql() -> str:
    syns = dims.all_synonyms() + [v for v in dims.EXTRA_INTENT_VERBS if v not in dims.all_synonyms()]
    vc = " + ".join(f"CASE WHEN contains(' ' || l || ' ', {O.q(' ' + s + ' ')}) THEN 1 ELSE 0 END"
                    for s in syns)
    single = " OR ".join(f"contains(l, {O.q(p)})" for p in dims.SINGLE_INTENT_PHRASES)
    st = O.strip_sql("x")

    def clean(arr):
        return f"list_filter(list_transform({arr}, lambda x: {st}), lambda x: x <> '')"

    n = len(FX.MULTI_PHRASES)
    return f"""WITH mr AS (SELECT o_orderkey AS req_id,
    {O.sql_list(FX.MULTI_PHRASES)}[(o_orderkey % {n}) + 1] AS text FROM orders),
s0 AS (SELECT req_id, {O.strip_sql('text')} AS t FROM mr),
s1 AS (SELECT *, lower(t) AS l, regexp_split_to_array(t, '\\d+\\.') AS num,
              regexp_split_to_array(t, '(?i)\\band\\b(?:\\s+also\\b)?') AS ands FROM s0),
s2 AS (SELECT req_id, CASE
    WHEN {single} THEN [t]
    WHEN len(num) - 1 >= 2 THEN {clean('num[2:]')}
    WHEN contains(t, ',') AND ({vc}) >= 2 AND len({clean("string_split(t, ',')")}) >= 2
      THEN {clean("string_split(t, ',')")}
    WHEN len(ands) >= 2 AND ({vc}) >= 2 AND len({clean('ands')}) >= 2 THEN {clean('ands')}
    ELSE [t] END AS parts FROM s1)
SELECT req_id, generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS sub_text FROM s2"""


register("split_requests", _split_sql())(
    lambda spark, d: C.split_requests(FX.multi_requests(spark, d)))


# ------------------------------------------------------------- replies ----
from canopy.operators import attempts as A  # noqa: E402
from canopy.operators import registry as G  # noqa: E402
from canopy.operators import replies as R  # noqa: E402


def _validated(spark, d):
    return R.validate_replies(FX.attempts(spark, d))


def _sections(spark, d):
    return R.pivot_sections(_validated(spark, d))


def _results(spark, d):
    return A.resolve_attempts(_validated(spark, d))


_V = f"WITH {O.attempts_cte()}, {O.validated_cte()}"

register("extract_sections", f"""{_V}
SELECT req_id, attempt, s.pos AS pos, s.section AS section, s.body AS body
FROM (SELECT req_id, attempt, unnest(secs) AS s FROM sec3)""")(
    lambda spark, d: R.extract_sections(FX.attempts(spark, d)))

register("validate_replies", f"""{_V}
SELECT req_id, attempt, status, CASE WHEN status = 'missing_section' THEN detail END AS detail,
       content_hash FROM hashed""")(
    lambda spark, d: _validated(spark, d).select("req_id", "attempt", "status", "detail",
                                                 "content_hash"))

register("reply_failure_rates", f"""{_V}
SELECT status, tpl_id, count(*) AS n FROM hashed GROUP BY status, tpl_id""")(
    lambda spark, d: R.failure_rates(_validated(spark, d), "tpl_id"))

_SEC_COLS = ["req_id", "attempt", "content_hash", "intent_classification", "signature",
             "implementation", "invariants", "test_oracle", "dependencies"]
register("pivot_sections", f"""{_V}
SELECT {', '.join(_SEC_COLS)} FROM sections""")(
    lambda spark, d: _sections(spark, d).select(*_SEC_COLS))

register("reply_hash_groups", f"""{_V}
SELECT content_hash, count(*) AS n_replies, count(DISTINCT req_id) AS n_requests,
       min(req_id) AS first_req_id FROM sections GROUP BY content_hash""")(
    lambda spark, d: R.hash_groups(_sections(spark, d)))

def _declared_sql(name):
    return (f"nullif(regexp_extract(intent_classification, "
            f"'(?m)^\\s*{name}\\s*:\\s*(\\S+)', 1), '')")


register("declared_vs_inferred", f"""WITH {O.pipeline(O.requests_cte())}, {O.attempts_cte()},
{O.validated_cte()},
declared AS (SELECT req_id, {_declared_sql("type")} AS declared_type,
    {_declared_sql("confidence")} AS declared_confidence,
    {_declared_sql("canonical_verb")} AS dv, {_declared_sql("canonical_noun")} AS dn FROM sections)
SELECT declared_type, intent_type AS inferred_type, declared_confidence,
       confidence AS inferred_confidence, count(*) AS n,
       count(*) FILTER (WHERE declared_type <> intent_type) AS n_type_mismatch,
       count(*) FILTER (WHERE dv <> verb) AS n_verb_mismatch,
       count(*) FILTER (WHERE dn <> noun) AS n_noun_mismatch,
       count(*) FILTER (WHERE declared_confidence IN ('MEDIUM', 'LOW')) AS n_unflagged
FROM declared JOIN classified USING (req_id) GROUP BY ALL""")(
    lambda spark, d: R.declared_vs_inferred(_sections(spark, d), _classified(spark, d)))

register("audit_sections", f"""{_V},
v AS (SELECT * FROM sections, (VALUES
  ('missing_preconditions'), ('missing_postconditions'), ('missing_edge_cases'),
  ('no_numeric_edge_case'), ('see_implementation'), ('few_asserts'), ('test_wrapper'),
  ('mock_stub_spy')) AS r(rule)
  WHERE CASE rule
    WHEN 'missing_preconditions' THEN NOT regexp_matches(invariants, '(?i)preconditions')
    WHEN 'missing_postconditions' THEN NOT regexp_matches(invariants, '(?i)postconditions')
    WHEN 'missing_edge_cases' THEN NOT regexp_matches(invariants, '(?i)edge[_ ]cases')
    WHEN 'no_numeric_edge_case' THEN NOT regexp_matches(invariants, '[0-9]')
    WHEN 'see_implementation' THEN regexp_matches(invariants, '(?i)see implementation')
    WHEN 'few_asserts' THEN (length(test_oracle) - length(replace(test_oracle, 'assert', ''))) // 6 < 3
    WHEN 'test_wrapper' THEN regexp_matches(test_oracle, '(?:^|[^A-Za-z0-9_])(?:describe|it|test)\\s*\\(')
    WHEN 'mock_stub_spy' THEN regexp_matches(test_oracle, '(?i)(?:mock|stub|spy|spies)') END)
SELECT rule, count(*) AS n_violations FROM v GROUP BY rule""")(
    lambda spark, d: R.audit_rates(_sections(spark, d)))

register("naming_audit", f"""{_V},
found(tpl_id, place, param) AS (VALUES {", ".join(
    f"({t}, {O.q(place)}, {O.q(name)})" for t, place, name in O.PARAMETER_FINDINGS)})
SELECT req_id, attempt, place, param FROM hashed JOIN found USING (tpl_id)
WHERE status = 'ok'""")(lambda spark, d: R.naming_audit(_sections(spark, d)))

# ------------------------------------------------------------ attempts ----
register("resolve_attempts", f"""{_V}
SELECT req_id, status, attempts_used, content_hash, error FROM results""")(
    lambda spark, d: _results(spark, d).drop("attempt"))

register("retry_stats", f"""{_V},
h AS (SELECT attempts_used, status, count(*) AS n FROM results GROUP BY ALL)
SELECT attempts_used, status, n,
       sum(n) OVER (PARTITION BY status ORDER BY attempts_used
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS cumulative,
       round(sum(n) OVER (PARTITION BY status ORDER BY attempts_used
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
             / sum(n) OVER (PARTITION BY status), 4) AS cumulative_share
FROM h""")(
    lambda spark, d: A.retry_stats(None, _results(spark, d)))

register("exhausted_reasons", f"""{_V}
SELECT attempt, status, count(*) AS n FROM hashed
WHERE req_id IN (SELECT req_id FROM results WHERE status = 'failed') GROUP BY ALL""")(
    lambda spark, d: A.exhausted_reasons(_validated(spark, d), _results(spark, d)))


def _prompts(spark, d):
    return C.bind_prompts(_passed(spark, d)).select("req_id", "user_message")


register("expand_retry_prompts", f"""WITH {O.pipeline(O.requests_cte())}, {O.attempts_cte()},
{O.validated_cte()},
bound AS (SELECT req_id, {_user_message_sql()} AS user_message FROM classified
          WHERE confidence = 'HIGH'),
p AS (SELECT req_id, user_message, unnest(range(1, attempts_used + 1)) AS attempt
      FROM bound JOIN results USING (req_id))
SELECT req_id, attempt, substr(sha256(user_message || repeat({O.q(dims.RETRY_SUFFIX)}, attempt - 1)),
       1, 16) AS prompt_hash,
       length(user_message || repeat({O.q(dims.RETRY_SUFFIX)}, attempt - 1)) AS prompt_length
FROM p""")(
    lambda spark, d: A.expand_retry_prompts(_prompts(spark, d), _results(spark, d)).select(
        "req_id", "attempt", A.prompt_hash(F.col("prompt")).alias("prompt_hash"),
        F.length("prompt").alias("prompt_length")))

# ------------------------------------------------------------ registry ----
_REC = ["content_hash", "intent_classification", "signature", "implementation", "invariants",
        "test_oracle", "dependencies"]


def _registry_input(spark, d):
    # one pass: the winning attempt carries its sections out of the aggregation
    carry = ["ts"] + [c for _, c in R.SECTION_COLUMNS]
    v = R.with_section_columns(_validated(spark, d))
    return A.resolve_attempts(v, carry=carry).select("req_id", "attempt", "status", "content_hash",
                                                      *carry)


def _registry(spark, d):
    return G.registry_upsert(None, _registry_input(spark, d))


_RESULTS_SEC = f"""{_V},
persisted AS (SELECT r.req_id, r.status, s.* EXCLUDE (req_id)
              FROM results r LEFT JOIN sections s
              ON r.req_id = s.req_id AND r.attempt = s.attempt)"""

register("registry_upsert", f"""{_RESULTS_SEC}
SELECT content_hash, {', '.join(f"arg_max({c}, (ts, req_id, attempt)) AS {c}" for c in _REC[1:])},
       max(ts) AS ts, arg_max(req_id, (ts, req_id, attempt)) AS req_id,
       arg_max(attempt, (ts, req_id, attempt)) AS attempt
FROM persisted WHERE implementation IS NOT NULL GROUP BY content_hash""")(
    lambda spark, d: _registry(spark, d)[0])

register("registry_rejects", f"""{_RESULTS_SEC}
SELECT status, count(*) AS n FROM persisted WHERE implementation IS NULL GROUP BY status""")(
    lambda spark, d: _registry_input(spark, d).where(F.col("implementation").isNull())
    .groupBy("status").agg(F.count("*").alias("n")))


def _lookup(spark, d):
    # replies are validated once, for the registry and for the keys that are looked up
    replies = stored(R.with_section_columns(_validated(spark, d)).select(
        "req_id", "attempt", "status", "content_hash", "ts", "code",
        *[c for _, c in R.SECTION_COLUMNS]), "validated-replies")
    carry = ["ts", *[c for _, c in R.SECTION_COLUMNS]]
    registry, _ = G.registry_upsert(None, A.resolve_attempts(replies, carry=carry).select(
        "req_id", "attempt", "status", "content_hash", *carry))
    keys = (replies.where(F.col("code").isNotNull())
            .select(R.T.hash16(F.col("code")).alias("content_hash")).distinct())
    return G.registry_lookup(registry, keys).select("content_hash", "found")


register("registry_lookup", f"""{_RESULTS_SEC},
reg AS (SELECT DISTINCT content_hash FROM persisted WHERE implementation IS NOT NULL),
keys AS (SELECT DISTINCT substr(sha256(code), 1, 16) AS content_hash FROM hashed
         WHERE code IS NOT NULL)
SELECT k.content_hash, r.content_hash IS NOT NULL AS found
FROM keys k LEFT JOIN reg r USING (content_hash)""")(_lookup)

register("registry_export", f"""{_RESULTS_SEC},
reg AS (SELECT content_hash,
    {', '.join(f"arg_max({c}, (ts, req_id, attempt)) AS {c}" for c in _REC[1:])}
    FROM persisted WHERE implementation IS NOT NULL GROUP BY content_hash)
SELECT content_hash, json_object({', '.join(f"'{c}', {c}" for c in _REC)})::VARCHAR AS json
FROM reg""")(
    lambda spark, d: G.registry_json(_registry(spark, d)[0]))


def _report_sql_expr() -> str:
    def block(title, col, first=False):
        return f"{'' if first else 'chr(10) || '}'=== {title} ===' || chr(10) || {col}"
    body = " || chr(10) || ".join([
        block("Intent Classification", "intent_classification", True),
        block("Signature", "signature"), block("Implementation", "implementation"),
        block("Invariants", "invariants"), block("Test Oracle", "test_oracle")])
    deps = ("CASE WHEN dependencies IS NOT NULL AND dependencies <> '' THEN chr(10) || "
            + block("Dependencies", "dependencies") + " || chr(10) ELSE chr(10) END")
    return (f"CASE WHEN implementation IS NULL THEN 'ERROR: No sections available' "
            f"ELSE {body} || {deps} || chr(10) || '[Hash: ' || content_hash || ']' END")


register("report_export", f"""{_RESULTS_SEC}
SELECT req_id, status, {_report_sql_expr()} AS report FROM persisted""")(
    lambda spark, d: G.report_text(
        _registry_input(spark, d)
        .withColumn("unclear_dimension", F.lit(None).cast("string"))
        .withColumn("clarifying_question", F.lit(None).cast("string"))
        .withColumn("assumed_interpretation", F.lit(None).cast("string")))
    .select("req_id", "status", "report"))

register("report_quarantine", f"""WITH {O.pipeline(O.requests_cte())}
SELECT req_id, 'AMBIGUITY DETECTED' || chr(10) || '  Unclear: ' || {O.gate_text("unclear_dimension")}
  || chr(10) || '  Question: ' || {O.gate_text("clarifying_question")}
  || chr(10) || '  Assumed: ' || {O.gate_text("assumed_interpretation")} AS report
FROM classified WHERE confidence <> 'HIGH'""")(
    lambda spark, d: G.report_text(C.gate(_classified(spark, d)).where(
        F.col("route") == "quarantine").withColumn("implementation", F.lit(None).cast("string"))
        .withColumn("content_hash", F.lit(""))
        .withColumn("dependencies", F.lit(None).cast("string"))
        .withColumn("intent_classification", F.lit(None).cast("string"))
        .withColumn("signature", F.lit(None).cast("string"))
        .withColumn("invariants", F.lit(None).cast("string"))
        .withColumn("test_oracle", F.lit(None).cast("string"))).select("req_id", "report"))


# --------------------------------------------------------- sub results ----
def _sub_results(spark, d):
    parts = C.split_requests(FX.multi_requests(spark, d))
    raw = parts.select(F.struct("req_id", "pos").alias("req_id"),
                       F.col("req_id").alias("session_id"),
                       F.lit(None).cast("timestamp").alias("ts"),
                       F.col("sub_text").alias("text"), F.lit("javascript").alias("alias"))
    ing = ingest_requests(raw)
    # free text and rejects in one pass; only spec rows need another
    cls = C.classify(C.canonicalise(ing.where((F.col("status") != "ok")
                                              | (F.col("source") == "freetext"))))
    ok, high = F.col("status") == "ok", F.col("confidence") == "HIGH"
    done = cls.select("req_id", F.when(~ok, "failed").when(high, "passed")
                      .otherwise("ambiguity").alias("result"),
                      F.when(~ok, F.col("status")).when(high, F.col("intent_key"))
                      .otherwise(F.col("confidence")).alias("detail")) \
        .withColumnRenamed("result", "status")
    spec_rows = ing.where((F.col("status") == "ok") & (F.col("source") == "yaml_spec")).select(
        F.to_json("req_id").alias("spec_id"), F.col("norm_text").alias("body"))
    specs = ingest_specs(spec_rows).select(
        F.from_json("spec_id", ing.schema["req_id"].dataType).alias("req_id"),
        F.when(F.col("error").isNull(), "passed").otherwise("failed").alias("status"),
        F.coalesce("error", "intent_type").alias("detail"))
    out = done.unionByName(specs).select("req_id.req_id", "req_id.pos",
                                                             "status", "detail")
    return A.collect_sub_results(out)


def _sub_results_sql() -> str:
    split = _split_sql()[len("WITH "):].replace(
        "\nSELECT req_id, generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS sub_text FROM s2",
        ",\nsplit AS (SELECT req_id AS orig_id, generate_subscripts(parts, 1) - 1 AS pos, "
        "unnest(parts) AS sub_text FROM s2)")
    parts_as_requests = """requests AS (SELECT {'orig_id': orig_id, 'pos': pos} AS req_id, orig_id AS session_id,
    NULL::TIMESTAMP AS ts, sub_text AS text, sub_text AS norm_src, 'javascript' AS alias FROM split)"""
    return "WITH " + ",\n".join([split, parts_as_requests, O.ingested_cte(), O.canonical_cte(),
                                   O.classified_cte()]) + """,
parts AS (
  SELECT req_id.orig_id AS orig_id, req_id.pos AS pos,
         CASE WHEN confidence = 'HIGH' THEN 'passed' ELSE 'ambiguity' END AS status,
         CASE WHEN confidence = 'HIGH' THEN intent_key ELSE confidence END AS detail
  FROM classified
  UNION ALL
  SELECT req_id.orig_id, req_id.pos, 'failed', status FROM ingested WHERE status <> 'ok')
SELECT orig_id AS req_id, count(*) AS n_parts,
       sum(CASE WHEN status = 'passed' THEN 1 ELSE 0 END)::BIGINT AS n_passed,
       sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END)::BIGINT AS n_failed,
       string_agg(status, ',' ORDER BY pos) AS statuses,
       string_agg(detail, '|' ORDER BY pos) AS details
FROM parts GROUP BY orig_id"""


register("collect_sub_results", _sub_results_sql())(_sub_results)

# --------------------------------------------------------------- drift ----
from canopy.operators import drift as D  # noqa: E402
from canopy.session import stored, table  # noqa: E402

_DRIFT_MSG = ("'DETERMINISM_VIOLATION' || chr(10) || '  intent_key: ' || intent_key || chr(10) || "
              "'  expected:   ' || expected || chr(10) || '  received:   ' || content_hash || "
              "chr(10) || '  Investigate before re-running.'")

register("assign_sessions", f"""WITH {O.results_seq_cte()}
SELECT req_id, session_id, session_no FROM sessioned""")(
    lambda spark, d: D.assign_sessions(FX.results_seq(spark, d)).select(
        "req_id", "session_id", "session_no"))

register("check_drift", f"""WITH {O.results_seq_cte()}
SELECT req_id, session_id, session_no, intent_key, expected, violation,
       CASE WHEN violation THEN {_DRIFT_MSG} END AS message FROM checked""")(
    lambda spark, d: D.check_drift(FX.results_seq(spark, d)).select(
        "req_id", "session_id", "session_no", "intent_key", "expected", "violation", "message"))

register("drift_report", f"""WITH {O.results_seq_cte()}
SELECT session_id, session_no, intent_key, count(*) AS n,
       count(DISTINCT content_hash) AS n_hashes,
       sum(CASE WHEN violation THEN 1 ELSE 0 END)::BIGINT AS n_violations,
       min(ts) FILTER (WHERE violation) AS first_violation_ts,
       arg_min(content_hash, (ts, req_id)) AS expected, max(mode_hash) AS mode_hash
FROM checked JOIN (
  SELECT session_id, session_no, intent_key, content_hash AS mode_hash
  FROM checked WHERE content_hash <> '' GROUP BY session_id, session_no, intent_key, content_hash
  QUALIFY row_number() OVER (PARTITION BY session_id, session_no, intent_key
                             ORDER BY count(*) DESC, content_hash) = 1)
  USING (session_id, session_no, intent_key)
WHERE content_hash <> '' GROUP BY session_id, session_no, intent_key HAVING count(DISTINCT content_hash) > 1""")(
    lambda spark, d: D.drift_report(D.check_drift(FX.results_seq(spark, d))))

register("drift_variants", f"""WITH {O.results_seq_cte()}
SELECT intent_key, content_hash, count(*) AS n FROM results WHERE content_hash <> ''
GROUP BY ALL""")(
    lambda spark, d: D.drift_variants(FX.results_seq(spark, d)))


register("drift_sketches", f"""WITH {O.results_seq_cte()}
SELECT intent_key, count(*) AS n, count(DISTINCT ts::DATE) AS n_days,
       count(DISTINCT content_hash) AS n_hashes
FROM results WHERE content_hash <> '' GROUP BY intent_key""")(
    lambda spark, d: D.sketched_variants(stored(D.hash_sketches(FX.results_seq(spark, d)),
                                                "hash-sketches")))


def _cross_session(spark, d):
    r = FX.results_seq(spark, d)
    early = F.year("ts") <= 1994
    return D.cross_session_drift(D.first_hashes(r.where(~early)), D.first_hashes(r.where(early)))


register("cross_session_drift", f"""WITH {O.results_seq_cte()},
b AS (SELECT intent_key, arg_min(content_hash, (ts, req_id)) AS baseline_hash FROM results
      WHERE year(ts) <= 1994 AND content_hash <> '' GROUP BY 1),
c AS (SELECT intent_key, arg_min(content_hash, (ts, req_id)) AS current_hash FROM results
      WHERE year(ts) > 1994 AND content_hash <> '' GROUP BY 1)
SELECT coalesce(b.intent_key, c.intent_key) AS intent_key, baseline_hash, current_hash,
       CASE WHEN baseline_hash IS NULL THEN 'new' WHEN current_hash IS NULL THEN 'gone'
            WHEN baseline_hash = current_hash THEN 'same' ELSE 'changed' END AS status
FROM b FULL OUTER JOIN c ON b.intent_key = c.intent_key""")(_cross_session)

_CELLS = ", ".join(f"({O.q(t)}, {O.q(l)})" for t in dims.TYPES for l in dims.LANGUAGES)
register("regression_matrix", f"""WITH {O.runs_cte()},
grid AS (SELECT * FROM (VALUES {_CELLS}) AS g(type, language)),
stats AS (SELECT type, language, count(*) AS calls, count(DISTINCT content_hash) AS n_hashes,
                 count(*) FILTER (WHERE phrasing = 0) AS n_canonical
          FROM runs GROUP BY ALL)
SELECT type, language, coalesce(calls, 0) AS calls, coalesce(n_canonical, 0) AS n_canonical,
       coalesce(n_hashes, 0) AS n_hashes,
       CASE WHEN calls IS NULL THEN 'missing' WHEN n_hashes > 1 THEN 'drift'
            WHEN n_canonical < 5 OR calls - n_canonical < 15 THEN 'short' ELSE 'pass' END AS status
FROM grid LEFT JOIN stats USING (type, language)""")(
    lambda spark, d: D.regression_matrix(FX.runs(spark, d)))

register("synonym_stability", f"""WITH {O.runs_cte()},
per AS (SELECT type, language, phrasing, count(DISTINCT content_hash) AS n_hashes,
               sha256(array_to_string(list_sort(list(DISTINCT content_hash)), ',')) AS sig
        FROM runs GROUP BY ALL),
cnt AS (SELECT type, language, sig, count(*) AS n FROM per GROUP BY ALL),
rule AS (SELECT * FROM cnt QUALIFY row_number() OVER (PARTITION BY type, language
                                                      ORDER BY n DESC, sig) = 1)
SELECT p.type, p.language, p.phrasing, p.n_hashes, r.n AS n_agreeing
FROM per p JOIN rule r USING (type, language) WHERE p.sig <> r.sig""")(
    lambda spark, d: D.synonym_stability(FX.runs(spark, d)))

# ---------------------------------------------------------------- logs ----
from canopy.operators import logs as L  # noqa: E402
from canopy.sources.logs import ingest_log  # noqa: E402


def _log(spark, d):
    return ingest_log(FX.log_lines(spark, d))[0]


def _calls(spark, d):
    return L.pair_calls(_log(spark, d))[0]


_LOG_COLS = ["event", "trace_id", "span_id", "ts", "model", "temperature", "max_tokens",
             "system_prompt_hash", "attempt", "content_hash", "tokens_in", "tokens_out",
             "latency_ms", "operation"]
_LOG_INTS = {"max_tokens", "attempt", "tokens_in", "tokens_out"}  # -1: the line has none
register("ingest_log", f"""WITH {O.log_cte()}
SELECT {', '.join(f"coalesce({c}, -1) AS {c}" if c in _LOG_INTS else c for c in _LOG_COLS)}
FROM log""")(lambda spark, d: _log_columns(_log(spark, d)))


def _log_columns(log):
    return log.select(*[F.coalesce(c, F.lit(-1)).cast("long").alias(c) if c in _LOG_INTS else c
                        for c in _LOG_COLS])


register("ingest_log_totals", f"""WITH {O.log_cte()}
SELECT event, count(*) AS n, count(DISTINCT trace_id) AS n_traces,
       coalesce(sum(tokens_in), 0)::BIGINT AS tokens_in,
       coalesce(sum(tokens_out), 0)::BIGINT AS tokens_out,
       coalesce(sum(round(latency_ms * 100)::BIGINT), 0)::BIGINT AS latency_cms,
       min(ts) AS first_ts, max(ts) AS last_ts
FROM log GROUP BY event""")(
    lambda spark, d: _log(spark, d).groupBy("event").agg(
        F.count("*").alias("n"), F.count_distinct("trace_id").alias("n_traces"),
        F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"),
        F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"),
        # latencies have two decimals: summing exact hundredths keeps the total exact
        F.coalesce(F.sum(F.round(F.col("latency_ms") * 100).cast("long")), F.lit(0))
        .alias("latency_cms"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))

register("ingest_log_corrupt", f"""WITH l AS (
  SELECT event_id, '{{"level":"info","timestamp":"'
         || CASE WHEN event_id % 1000 = 17 THEN 'not a time'
                 ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END
         || '","event":"llm_call_start","trace_id":"t' || user_id || '","span_id":"'
         || upper(to_hex(event_id)) || '","model":"'
         || CASE WHEN event_id % 307 = 0 THEN {O.q(FX.OFF_PIN_MODEL)}
                 ELSE {O.q(dims.PINNED_MODEL)} END
         || '","temperature":' || CASE WHEN event_id % 501 = 0 THEN '0.5' ELSE '0.0' END
         || ',"max_tokens":' || CASE WHEN event_id % 1000 = 13 THEN '"lots"'
                                     ELSE '{dims.PINNED_MAX_TOKENS}' END
         || ',"system_prompt_hash":"'
         || CASE WHEN event_id % 997 = 0 THEN {O.q(FX.SYSTEM_PROMPT_HASHES[1])}
                 ELSE {O.q(FX.SYSTEM_PROMPT_HASHES[0])} END
         || '","user_prompt":"Language target: javascript\\nIntent type: ' || upper(event_type)
         || '","attempt":' || (event_id % 3 + 1) || '}}' AS line
  FROM events WHERE event_id % 1000 IN (7, 13, 17))
SELECT CASE WHEN event_id % 1000 = 7 THEN substr(line, 1, 40) ELSE line END AS line
FROM l""")(lambda spark, d: ingest_log(FX.log_lines(spark, d))[1])

register("span_latency", f"""WITH {O.log_cte()}
SELECT operation, count(*) AS n,
       round(sum(round(latency_ms * 100)::BIGINT) / count(*) / 100, 4) AS mean_ms,
       round(quantile_cont(latency_ms, 0.5), 4) AS p50_ms,
       round(quantile_cont(latency_ms, 0.95), 4) AS p95_ms,
       round(quantile_cont(latency_ms, 0.99), 4) AS p99_ms, max(latency_ms) AS max_ms
FROM log WHERE event = 'span_completed' GROUP BY operation""")(
    lambda spark, d: L.span_latency(_log(spark, d)))

register("span_latency_approx", f"""WITH {O.log_cte()}
SELECT operation, count(*) AS n,
       round(sum(round(latency_ms * 100)::BIGINT) / count(*) / 100, 4) AS mean_ms,
       quantile_disc(latency_ms, 0.5) AS p50_ms, quantile_disc(latency_ms, 0.95) AS p95_ms,
       quantile_disc(latency_ms, 0.99) AS p99_ms, max(latency_ms) AS max_ms
FROM log WHERE event = 'span_completed' GROUP BY operation""")(
    lambda spark, d: L.span_latency_approx(_log(spark, d)).select(
        "operation", "n", "mean_ms", "max_ms", *[F.col("quantiles")[i].alias(c)
                            for i, c in enumerate(("p50_ms", "p95_ms", "p99_ms"))]))

register("pair_calls", f"""WITH {O.log_cte()}
SELECT trace_id, span_id, start_ts, end_ts, tokens_in, tokens_out, latency_ms, model FROM calls""")(
    lambda spark, d: _calls(spark, d).select("trace_id", "span_id", "start_ts", "end_ts",
                                             "tokens_in", "tokens_out", "latency_ms", "model"))

register("call_orphans", f"""WITH {O.log_cte()}
SELECT coalesce(s.trace_id, d.trace_id) AS trace_id, coalesce(s.span_id, d.span_id) AS span_id,
       CASE WHEN d.span_id IS NULL THEN 'failed_call' ELSE 'complete_without_start' END AS kind
FROM starts s FULL OUTER JOIN dones d ON s.trace_id = d.trace_id AND s.span_id = d.span_id
WHERE s.span_id IS NULL OR d.span_id IS NULL""")(
    lambda spark, d: L.pair_calls(_log(spark, d))[1].select("trace_id", "span_id", "kind"))

register("usage_rollup", f"""WITH {O.log_cte()}
SELECT model, session_id, date_trunc('hour', start_ts) AS hour,
       GROUPING(model, session_id, date_trunc('hour', start_ts)) AS gid, count(*) AS calls,
       sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out,
       sum(CASE WHEN attempt > 1 THEN 1 ELSE 0 END)::BIGINT AS retries
FROM calls GROUP BY ROLLUP (model, session_id, date_trunc('hour', start_ts))""")(
    lambda spark, d: L.usage_rollup(_calls(spark, d)))

register("context_budget", f"""WITH {O.log_cte()},
r AS (SELECT *, tokens_in + tokens_out AS tokens,
             sum(tokens_in + tokens_out) OVER (PARTITION BY session_id ORDER BY start_ts, span_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_tokens FROM calls)
SELECT session_id, span_id, start_ts, running_tokens::BIGINT AS running_tokens,
       5000 AS window_tokens
FROM r WHERE running_tokens >= 2000 AND running_tokens - tokens < 2000""")(
    lambda spark, d: L.context_budget(_calls(spark, d), 5000))

register("config_lock_audit", f"""WITH {O.log_cte()}
SELECT session_id, span_id, 'temperature' AS kind FROM starts WHERE temperature <> 0
UNION ALL
SELECT session_id, span_id, 'model' FROM starts
WHERE model <> {O.q(dims.PINNED_MODEL)} OR contains(model, 'latest') OR contains(model, 'preview')
UNION ALL
SELECT session_id, span_id, 'max_tokens' FROM starts WHERE max_tokens <> {dims.PINNED_MAX_TOKENS}
UNION ALL
SELECT session_id, NULL, 'system_prompt' FROM starts GROUP BY session_id
HAVING count(DISTINCT system_prompt_hash) > 1""")(
    lambda spark, d: L.config_lock_audit(
        _log(spark, d).where(F.col("event") == "llm_call_start")))

register("prompt_audit", f"""WITH {O.pipeline(O.requests_cte())},
r AS (SELECT *, substr(sha256(text), 1, 16) AS prompt_hash FROM requests),
f AS (SELECT session_id, prompt_hash, arg_min(req_id, (ts, req_id)) AS first_req_id FROM r
      GROUP BY ALL)
SELECT r.req_id, r.session_id, r.ts, r.prompt_hash, c.intent_type, c.confidence,
       r.req_id <> f.first_req_id AS repeated
FROM r JOIN f USING (session_id, prompt_hash) LEFT JOIN classified c ON c.req_id = r.req_id""")(
    lambda spark, d: L.prompt_audit(FX.requests(spark, d)))


def _everything(spark, d):
    """(classification of both branches, results of their replies)."""
    classified = C.classify_all(FX.mixed_requests(spark, d))
    return classified, A.resolve_attempts(R.validate_replies(FX.mixed_attempts(spark, d)))


def _funnel(spark, d):
    return L.funnel_counts(L.request_outcomes(*_everything(spark, d)))


_OUTCOMES = f"""WITH {O.mixed_cte()}, {O.mixed_attempts_cte()}, {O.validated_cte()},
outcomes AS (
  SELECT e.req_id, e.source, CASE WHEN rejected THEN 1 WHEN e.error IS NOT NULL THEN 2
           WHEN confidence <> 'HIGH' THEN 3 WHEN r.status IS NULL THEN 4
           WHEN r.status <> 'ok' THEN 5 ELSE 6 END AS reached,
         CASE WHEN e.error IS NOT NULL THEN split_part(e.error, ':', 1)
              WHEN confidence <> 'HIGH' THEN confidence WHEN r.status IS NULL THEN 'no result'
              WHEN r.status <> 'ok' THEN r.status END AS reason,
         CASE WHEN confidence = 'HIGH' THEN {_user_message_sql()} END AS prompt, r.content_hash
  FROM every e LEFT JOIN results r USING (req_id))"""

register("pipeline_funnel", f"""{_OUTCOMES},
st AS (
  SELECT k AS stage_no, s AS stage, (SELECT count(*) FROM outcomes WHERE reached >= k) AS n
  FROM (VALUES {", ".join(f"({k}, {O.q(s)})" for k, s in enumerate(L.FUNNEL, 1))}) AS v(k, s))
SELECT stage_no, stage, n, round(n / lag(n) OVER (ORDER BY stage_no), 4) AS conversion FROM st
UNION ALL SELECT 7, 'distinct_prompts', count(DISTINCT prompt), NULL FROM outcomes
UNION ALL SELECT 8, 'registry_records', count(DISTINCT content_hash), NULL FROM outcomes
          WHERE reached = 6""")(lambda spark, d: L.pipeline_funnel(_funnel(spark, d)))

register("funnel_losses", f"""{_OUTCOMES}
SELECT {O.sql_list(L.FUNNEL)}[reached] AS lost_after, source, reason, count(*) AS n
FROM outcomes WHERE reason IS NOT NULL GROUP BY ALL""")(
    lambda spark, d: L.funnel_losses(_funnel(spark, d)))

_EVERY_COLS = ["req_id", "source", "language", "verb", "noun", "intent_type", "confidence",
               "intent_key"]
register("classify_all", f"""WITH {O.mixed_cte()}
SELECT {", ".join(_EVERY_COLS)}, split_part(error, ':', 1) AS error_kind FROM every""")(
    lambda spark, d: C.classify_all(FX.mixed_requests(spark, d)).select(
        *_EVERY_COLS, F.regexp_extract("error", "^[^:]+", 0).alias("error_kind")))

register("pipeline_drift", f"""WITH {O.mixed_cte()}, {O.mixed_attempts_cte()}, {O.validated_cte()},
j AS (SELECT e.req_id, e.session_id, e.ts, e.intent_key, r.content_hash
      FROM every e JOIN results r USING (req_id) WHERE e.confidence = 'HIGH'),
x AS (SELECT session_id, intent_key, arg_min(content_hash, (ts, req_id)) AS first_hash
      FROM j WHERE content_hash <> '' GROUP BY ALL)
SELECT req_id, session_id, intent_key, content_hash,
       CASE WHEN content_hash <> '' THEN first_hash END AS expected,
       content_hash <> '' AND content_hash <> first_hash AS violation
FROM j LEFT JOIN x USING (session_id, intent_key)""")(
    lambda spark, d: D.check_drift(D.resolved_results(*_everything(spark, d))).select(
        "req_id", "session_id", "intent_key", "content_hash", "expected", "violation"))

_SYSTEM_PROMPT = "Answer with the required sections only."
register("prompt_system", f"""WITH {O.pipeline(O.requests_cte())}
SELECT DISTINCT substr(sha256({_user_message_sql()}), 1, 16) AS prompt_id,
       substr(sha256({O.q(_SYSTEM_PROMPT)}), 1, 16) AS system_prompt_hash,
       {O.q(_SYSTEM_PROMPT)} AS system_prompt
FROM classified WHERE confidence = 'HIGH'""")(
    lambda spark, d: C.bind_system_prompt(
        C.build_prompt_work(_passed(spark, d))[0], _SYSTEM_PROMPT)
    .join(C.system_prompts(spark, [_SYSTEM_PROMPT]), "system_prompt_hash").select(
        "prompt_id", "system_prompt_hash", "system_prompt"))

# ------------------------------------------------------------ projects ----
from canopy.operators import projects as P  # noqa: E402


def _proj(spark, d):
    return P.ingest_projects(FX.projects(spark, d))


def _items_edges(spark, d):
    out = _proj(spark, d)
    edges = P.link_contracts(out["functions"], out["contracts"])
    return P.generation_items(out["contracts"], out["functions"], edges), edges, out


_PW = f"WITH {O.projects_cte()}"
register("project_violations", f"""{_PW}
SELECT project_id, error FROM pviol""")(
    lambda spark, d: _proj(spark, d)["violations"])

register("project_functions", f"""{_PW}
SELECT project_id, project_language, m_pos, module, f_pos, intent, language_override FROM pfun""")(
    lambda spark, d: _proj(spark, d)["functions"])

register("link_contracts", f"""{_PW}
SELECT project_id, key, dep FROM pedges""")(
    lambda spark, d: _items_edges(spark, d)[1])

register("generation_items", f"""{_PW}
SELECT i.project_id, i.key, i.intent, i.language, i.module,
       coalesce(string_agg(e.dep, ',' ORDER BY e.dep), '') AS deps, count(e.dep) AS n_deps
FROM pitems i LEFT JOIN pedges e USING (project_id, key)
GROUP BY i.project_id, i.key, i.intent, i.language, i.module""")(
    lambda spark, d: _items_edges(spark, d)[0].select(
        "project_id", "key", "intent", "language", "module", "deps", "n_deps"))

register("build_order", f"""WITH RECURSIVE {O.projects_cte()},
-- Kahn's algorithm with a sorted ready queue, step by step: pop the smallest key
-- whose dependencies are all done (an independent statement of the rule)
kahn(project_id, step, done) AS (
  SELECT DISTINCT project_id, 0, []::VARCHAR[] FROM pitems
  UNION ALL
  SELECT k.project_id, k.step + 1, list_append(k.done, (
    SELECT min(i.key) FROM pitems i
    WHERE i.project_id = k.project_id AND NOT list_contains(k.done, i.key)
      AND NOT EXISTS (SELECT 1 FROM pedges e WHERE e.project_id = i.project_id
                      AND e.key = i.key AND NOT list_contains(k.done, e.dep))))
  FROM kahn k
  WHERE k.step < (SELECT count(*) FROM pitems i WHERE i.project_id = k.project_id)),
final AS (SELECT project_id, arg_max(done, step) AS done FROM kahn GROUP BY project_id)
SELECT project_id, unnest(done) AS key, generate_subscripts(done, 1) AS position FROM final""")(
    lambda spark, d: P.build_order(*_items_edges(spark, d)[:2]))

register("declared_order", f"""{_PW},
u AS (SELECT project_id, 'contract:' || contract AS key, 0 AS k, c_pos AS a, 0 AS b FROM pcon
      UNION ALL SELECT project_id, module || ':' || intent, 1, m_pos, f_pos FROM pfun)
SELECT project_id, key, row_number() OVER (PARTITION BY project_id ORDER BY k, a, b) AS position,
       count(*) OVER (PARTITION BY project_id) AS total FROM u""")(
    lambda spark, d: (lambda o: P.declared_order(o["contracts"], o["functions"]))(_proj(spark, d)))


def _levels(spark, d):
    nodes, edges = FX.graph(spark, d)
    # cyclic nodes have no level; shown as -1 next to the cyclic flag
    return P.build_levels(nodes, edges).withColumn("level", F.coalesce("level", F.lit(-1)))


register("build_levels", """WITH RECURSIVE
nodes AS (SELECT p_partkey AS node FROM part UNION ALL SELECT 900001 UNION ALL SELECT 900002),
edges AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey >= 2
          UNION ALL SELECT 900001, 900002 UNION ALL SELECT 900002, 900001
          UNION ALL SELECT 3, 999999999),
bad0 AS (SELECT DISTINCT e.src AS node FROM edges e WHERE e.dst NOT IN (SELECT node FROM nodes)),
closure(node, dep) AS (
  SELECT src, dst FROM edges
  UNION
  SELECT c.node, e.dst FROM closure c JOIN edges e ON e.src = c.dep),
cyc AS (SELECT DISTINCT node FROM closure WHERE node = dep),
blocked AS (
  SELECT node FROM bad0 UNION SELECT node FROM cyc
  UNION SELECT c.node FROM closure c WHERE c.dep IN (SELECT node FROM bad0)
                                       OR c.dep IN (SELECT node FROM cyc)),
depth(node, level) AS (
  SELECT node, 0 FROM nodes WHERE node NOT IN (SELECT src FROM edges)
  UNION
  SELECT e.src, d.level + 1 FROM depth d JOIN edges e ON e.dst = d.node),
lv AS (SELECT node, max(level) AS level FROM depth GROUP BY node)
SELECT n.node, CASE WHEN n.node IN (SELECT node FROM blocked) THEN -1 ELSE lv.level END AS level,
       n.node IN (SELECT node FROM blocked) AS cyclic
FROM nodes n LEFT JOIN lv USING (node)""")(_levels)


def _deps(spark, d):
    return P.extract_dependencies(_sections(spark, d))


_DEPS_SQL = f"""{_V},
dl AS (SELECT req_id, attempt, string_split_regex({O.strip_sql('dependencies')},
         '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS lines
       FROM sections WHERE dependencies IS NOT NULL AND {O.strip_sql('dependencies')} <> ''),
dl2 AS (SELECT req_id, attempt, generate_subscripts(lines, 1) - 1 AS pos, unnest(lines) AS line FROM dl),
dl3 AS (SELECT req_id, attempt, pos, {O.strip_sql(O.strip_sql('line').replace("'{WS}+$'", "x"))} AS raw_line,
               {O.strip_sql(f"regexp_replace({O.strip_sql('line')}, ',+$', '')")} AS c FROM dl2),
deps AS (SELECT req_id, attempt, pos::INTEGER AS pos,
    CASE WHEN contains(c, ' as ') THEN {O.strip_sql("split_part(c, ' as ', 1)")}
         WHEN starts_with(c, '- ') THEN {O.strip_sql("substr(c, 3)")} ELSE c END AS module,
    CASE WHEN contains(c, ' as ') THEN {O.strip_sql("substr(c, strpos(c, ' as ') + 4)")} END AS alias
  FROM dl3 WHERE raw_line <> '' AND NOT starts_with(raw_line, '#') AND c <> '')"""

register("extract_dependencies", f"""{_DEPS_SQL}
SELECT req_id, attempt, pos, module, coalesce(alias, '') AS alias FROM deps""")(
    lambda spark, d: _deps(spark, d).withColumn("alias", F.coalesce("alias", F.lit(""))))


def _imports(spark, d):
    langs = (ingest_requests(FX.requests(spark, d)).where(F.col("language").isNotNull())
             .select("req_id", "language"))
    return (P.render_imports(_deps(spark, d), langs)
            .groupBy("language", "statement").agg(F.count("*").alias("n")))


register("render_imports", f"""WITH {O.requests_cte()}, {O.ingested_cte()}, {_DEPS_SQL[5:]},
st AS (SELECT DISTINCT d.req_id, i.language, CASE
    WHEN i.language IN ('javascript', 'typescript') THEN CASE WHEN d.alias IS NOT NULL
      THEN 'import * as ' || d.alias || ' from ''' || d.module || ''';'
      ELSE 'import ' || d.module || ' from ''' || d.module || ''';' END
    WHEN i.language = 'python' THEN CASE WHEN d.alias IS NOT NULL
      THEN 'import ' || d.module || ' as ' || d.alias ELSE 'import ' || d.module END
    WHEN i.language = 'go' THEN CASE WHEN d.alias IS NOT NULL
      THEN d.alias || ' "' || d.module || '"' ELSE '"' || d.module || '"' END END AS statement
  FROM deps d JOIN ingested i ON d.req_id = i.req_id WHERE i.language IS NOT NULL)
SELECT language, statement, count(*) AS n FROM st GROUP BY ALL""")(_imports)

register("dependency_usage", f"""{_DEPS_SQL}
SELECT module, count(*) AS n_results FROM (SELECT DISTINCT req_id, attempt, module FROM deps)
GROUP BY module ORDER BY n_results DESC, module LIMIT 10""")(
    lambda spark, d: P.dependency_usage(_deps(spark, d)))

register("dependency_cooccurrence", f"""{_DEPS_SQL},
dd AS (SELECT DISTINCT req_id, attempt, module FROM deps)
SELECT a.module AS m1, b.module AS m2, count(*) AS n FROM dd a JOIN dd b
  ON a.req_id = b.req_id AND a.attempt = b.attempt AND a.module < b.module GROUP BY ALL""")(
    lambda spark, d: P.dependency_cooccurrence(_deps(spark, d)))

# --------------------------------------------------------------- specs ----
from canopy.sources.specs import ingest_specs  # noqa: E402

_SPEC_ROWS = ", ".join(
    "(" + ", ".join([str(i), *("NULL" if x is None else O.q(x) for x in row)]) + ")"
    for i, row in enumerate(O.SPEC_RESULTS))
register("ingest_specs", f"""SELECT o_orderkey AS spec_id, source, intent_type, verb, noun, language,
       CASE WHEN error IS NULL THEN 'HIGH' END AS confidence, error
FROM orders JOIN (VALUES {_SPEC_ROWS}) AS v(i, source, intent_type, verb, noun, language, error)
  ON o_orderkey % {len(FX.SPEC_TEXTS)} = i""")(
    lambda spark, d: ingest_specs(FX.specs(spark, d)))

# ----------------------------------------------------------- streaming ----
from canopy.streaming import calls as SC  # noqa: E402
from canopy.streaming import registry_table as SR  # noqa: E402
from canopy.streaming import streams as S  # noqa: E402


ARRIVALS = 3  # slices of a stream's source; each arrives after the one before was read


def _time_slices(df, time_col, n=ARRIVALS):
    """``df`` cut at quantiles of its time, in time order."""
    us = F.unix_micros(F.col(time_col).cast("timestamp"))
    cuts = df.agg(F.percentile_approx(us, [k / n for k in range(1, n)], 1000)).first()[0] or []
    bounds = [None, *cuts, None]
    for low, high in zip(bounds, bounds[1:]):
        part = df if low is None else df.where(us > low)
        yield part if high is None else part.where((us <= high) if low is not None else
                                                   (us <= high) | us.isNull())


def _stream_drift(spark, d):
    base = S.scratch(spark, "drift")
    src = FX.results_seq(spark, d)
    for part in _time_slices(src, "ts"):
        part.write.mode("append").parquet(base + "/src")
        S.advance_stream_drift(S.file_stream(spark, base + "/src", src.schema), base + "/out")
    return S.read_stream_drift(spark, base + "/out").select(
        "req_id", "session_id", "session_no", "intent_key", "expected", "violation", "message")


register("stream_drift", ORACLE["check_drift"])(_stream_drift)


def _stream_window(kind):
    def run(spark, d):
        base = S.scratch(spark, kind)
        src = table(spark, d, "events")
        for part in (*_time_slices(src, "ts"), S.closing_sentinel(src, kind)):
            part.write.mode("append").parquet(base + "/src")
            S.advance_metrics(S.file_stream(spark, base + "/src", src.schema), base + "/out", kind)
        return spark.read.parquet(base + "/out/data")
    return run


register("stream_call_metrics", """SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start,
       time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE AS window_end, count(*) AS calls,
       sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS errors,
       sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS tokens
FROM events GROUP BY 1, 2""")(_stream_window("tumbling"))


LINES_PER_FILE = 250_000  # of the stand-in log, some 60 MB of text


def _stream_log(spark, d, then=None):
    """Log lines arrive in slices of time; after each the streams go on."""
    base = S.scratch(spark, "log")
    for part in _time_slices(table(spark, d, "events"), "ts"):
        # a compressed file is read by one task, so its lines are bounded
        FX.log_lines(spark, d, part).write.mode("append").option("compression", "gzip").option(
            "maxRecordsPerFile", LINES_PER_FILE).text(base + "/src")
        lines = S.file_stream(spark, base + "/src", "value string", fmt="text").withColumnRenamed(
            "value", "line")
        SC.advance_log(lines, base + "/log")
        if then:
            then(base)
    return base


def _stream_ingest(spark, d):
    return SC.read_log(spark, _stream_log(spark, d) + "/log")


def _stream_pairs(spark, d):
    schema = ingest_log(FX.log_lines(spark, d))[0].schema

    def pair(base, close=False):
        log = spark.readStream.schema(schema).parquet(base + "/log/log/*")
        SC.advance_calls(log, base + "/calls", close=close)

    base = _stream_log(spark, d, pair)
    pair(base, close=True)
    return SC.read_calls(spark, base + "/calls")


register("stream_ingest_log", ORACLE["ingest_log"])(
    lambda spark, d: _log_columns(_stream_ingest(spark, d)[0]))

register("stream_ingest_log_corrupt", ORACLE["ingest_log_corrupt"])(
    lambda spark, d: _stream_ingest(spark, d)[1])

_CALL_COLS = ["trace_id", "span_id", "start_ts", "end_ts", "tokens_in", "tokens_out",
              "latency_ms", "model"]
register("stream_pair_calls", ORACLE["pair_calls"])(
    lambda spark, d: _stream_pairs(spark, d)[0].select(*_CALL_COLS))

register("stream_call_orphans", ORACLE["call_orphans"])(
    lambda spark, d: _stream_pairs(spark, d)[1].select("trace_id", "span_id", "kind"))

# -------------------------------------------------------------- extras ----
register("verb_gap_by_lang", f"""WITH {O.documents_cte().replace("'javascript' AS alias", "'javascript' AS alias, lang")},
{O.ingested_cte()}, {O.canonical_cte()},
c AS (SELECT lang, regexp_extract(lower(norm_text), '[a-z]+') AS word, count(*) AS n FROM canonical
      WHERE verb = 'unknown' AND regexp_extract(lower(norm_text), '[a-z]+') <> '' GROUP BY ALL),
r AS (SELECT *, dense_rank() OVER (PARTITION BY lang ORDER BY n DESC) AS rank FROM c)
SELECT lang, word, n, rank FROM r WHERE rank <= 5""")(
    lambda spark, d: C.verb_gap_by_group(C.canonicalise(
        ingest_requests(FX.document_requests(spark, d)).where(
            (F.col("status") == "ok") & (F.col("source") == "freetext")))))

register("regression_pivot", f"""WITH {O.runs_cte()},
grid AS (SELECT * FROM (VALUES {_CELLS}) AS g(type, language)),
stats AS (SELECT type, language, count(*) AS calls, count(DISTINCT content_hash) AS n_hashes,
                 count(*) FILTER (WHERE phrasing = 0) AS n_canonical
          FROM runs GROUP BY ALL),
m AS (SELECT type, language, CASE WHEN calls IS NULL THEN 'missing' WHEN n_hashes > 1 THEN 'drift'
             WHEN n_canonical < 5 OR calls - n_canonical < 15 THEN 'short' ELSE 'pass' END AS status
      FROM grid LEFT JOIN stats USING (type, language))
SELECT type, {', '.join(f"max(CASE WHEN language = {O.q(l)} THEN status END) AS {l}" for l in dims.LANGUAGES)}
FROM m GROUP BY type""")(
    lambda spark, d: D.regression_pivot(D.regression_matrix(FX.runs(spark, d))))


register("stream_sliding_metrics", """WITH e AS (
  SELECT ts, event_type, json_extract_string(props, '$.k')::BIGINT AS tokens,
         time_bucket(INTERVAL 5 MINUTE, ts) - k * INTERVAL 5 MINUTE AS window_start
  FROM events, (VALUES (0), (1), (2)) AS w(k))
SELECT window_start, window_start + INTERVAL 15 MINUTE AS window_end, count(*) AS calls,
       sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS errors,
       sum(tokens)::BIGINT AS tokens
FROM e GROUP BY 1, 2""")(_stream_window("sliding"))

register("stream_session_metrics", """WITH e AS (
  SELECT user_id, ts, event_type, json_extract_string(props, '$.k')::BIGINT AS tokens,
         CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE
              THEN 0 ELSE 1 END AS starts
  FROM events),
s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sno FROM e)
SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, count(*) AS calls,
       sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS errors,
       sum(tokens)::BIGINT AS tokens
FROM s GROUP BY user_id, sno""")(_stream_window("session"))

_SESSION_SQL = ORACLE["stream_session_metrics"]


def _user_sessions(spark, d):
    """Sessions of the event users with a pause of 30 minutes, in batch."""
    e = table(spark, d, "events").select(
        "user_id", "ts", "event_id", "event_type",
        F.get_json_object("props", "$.k").try_cast("long").alias("tokens"))
    return (D.gap_sessions(e, "user_id", "ts", "event_id", 30 * 60)
            .groupBy("user_id", "session_no").agg(
                F.min("ts").alias("window_start"),
                (F.max("ts") + F.expr("INTERVAL 30 MINUTES")).alias("window_end"),
                F.count("*").alias("calls"),
                F.sum((F.col("event_type") == "error").cast("int")).alias("errors"),
                F.sum("tokens").alias("tokens")).drop("session_no"))


register("gap_sessions", _SESSION_SQL)(_user_sessions)

register("classify_conversations", f"""WITH {O.pipeline(O.conversations_cte())}
SELECT req_id, language, intent_type, confidence, intent_key,
       array_to_string(matches, ',') AS matches FROM classified""")(
    lambda spark, d: _classified(spark, d, FX.conversation_requests).select(
        *_CLASSIFY_COLS, F.array_join("matches", ",").alias("matches")))


register("regression_cube", f"""WITH {O.runs_cte()}
SELECT type, language, GROUPING(type, language) AS gid, count(*) AS calls,
       count(DISTINCT content_hash) AS n_hashes
FROM runs GROUP BY CUBE (type, language)""")(
    lambda spark, d: D.regression_cube(FX.runs(spark, d)))


def _stream_registry(spark, d):
    base = S.scratch(spark, "registry")
    att = FX.attempts(spark, d)
    for a in (1, 2, 3):  # replies arrive attempt by attempt
        att.where(F.col("attempt") == a).write.mode("append").parquet(base + "/src")
        stream = S.file_stream(spark, base + "/src", att.schema)
        sections = R.pivot_sections(R.validate_replies(stream))
        registry = SR.stream_registry_upsert(sections, base + "/registry")
    return registry.read()


register("stream_registry_upsert", f"""{_V}
SELECT content_hash, {', '.join(f"arg_max({c}, (ts, req_id, attempt)) AS {c}" for c in _REC[1:])},
       max(ts) AS ts, arg_max(req_id, (ts, req_id, attempt)) AS req_id,
       arg_max(attempt, (ts, req_id, attempt)) AS attempt
FROM sections GROUP BY content_hash""")(_stream_registry)


# ------------------------------------------------- further dimensions ----
register("taxonomy_transitions", f"""SELECT old_type, new_type, old_confidence, new_confidence,
       count(*) AS n FROM ({_taxonomy_sql(O.requests_cte())}) GROUP BY ALL""")(
    lambda spark, d: C.taxonomy_transitions(C.taxonomy_diff(FX.requests(spark, d))))

register("prompt_fanout", f"""WITH {O.pipeline(O.requests_cte())}
SELECT req_id, substr(sha256({_user_message_sql()}), 1, 16) AS prompt_id
FROM classified WHERE confidence = 'HIGH'""")(
    lambda spark, d: C.build_prompt_work(_passed(spark, d))[1])

register("reply_failures_by_language", f"""WITH {O.requests_cte()}, {O.ingested_cte()},
{_V[5:]}
SELECT h.status, i.language, count(*) AS n
FROM hashed h JOIN ingested i ON h.req_id = i.req_id GROUP BY ALL""")(
    lambda spark, d: R.failure_rates(_validated(spark, d).join(
        ingest_requests(FX.requests(spark, d)).select("req_id", "language"), "req_id"), "language"))

register("audit_rates_by_type", f"""{_V},
r AS (SELECT nullif(regexp_extract(intent_classification, '(?m)^\\s*type\\s*:\\s*(\\S+)', 1), '')
        AS declared_type, rule, CASE rule
    WHEN 'missing_preconditions' THEN NOT regexp_matches(invariants, '(?i)preconditions')
    WHEN 'missing_postconditions' THEN NOT regexp_matches(invariants, '(?i)postconditions')
    WHEN 'missing_edge_cases' THEN NOT regexp_matches(invariants, '(?i)edge[_ ]cases')
    WHEN 'no_numeric_edge_case' THEN NOT regexp_matches(invariants, '[0-9]')
    WHEN 'see_implementation' THEN regexp_matches(invariants, '(?i)see implementation')
    WHEN 'few_asserts' THEN (length(test_oracle) - length(replace(test_oracle, 'assert', ''))) // 6 < 3
    WHEN 'test_wrapper' THEN regexp_matches(test_oracle, '(?:^|[^A-Za-z0-9_])(?:describe|it|test)\\s*\\(')
    WHEN 'mock_stub_spy' THEN regexp_matches(test_oracle, '(?i)(?:mock|stub|spy|spies)') END AS bad
  FROM sections, (VALUES ('missing_preconditions'), ('missing_postconditions'),
    ('missing_edge_cases'), ('no_numeric_edge_case'), ('see_implementation'), ('few_asserts'),
    ('test_wrapper'), ('mock_stub_spy')) AS v(rule))
SELECT rule, declared_type, count(*) AS n_replies,
       sum(CASE WHEN bad THEN 1 ELSE 0 END)::BIGINT AS n_violations,
       round(sum(CASE WHEN bad THEN 1 ELSE 0 END) / count(*), 6) AS rate FROM r GROUP BY ALL""")(
    lambda spark, d: R.audit_rates_by_type(_sections(spark, d)))


def _session_drift(spark, d):
    r, keys = FX.results_seq(spark, d), ["session_id", "intent_key"]
    early = F.year("ts") <= 1994
    return D.cross_session_drift(D.first_hashes(r.where(~early), keys),
                                 D.first_hashes(r.where(early), keys), keys)


register("cross_session_drift_by_session", f"""WITH {O.results_seq_cte()},
b AS (SELECT session_id, intent_key, arg_min(content_hash, (ts, req_id)) AS baseline_hash
      FROM results WHERE year(ts) <= 1994 AND content_hash <> '' GROUP BY ALL),
c AS (SELECT session_id, intent_key, arg_min(content_hash, (ts, req_id)) AS current_hash
      FROM results WHERE year(ts) > 1994 AND content_hash <> '' GROUP BY ALL)
SELECT session_id, intent_key, baseline_hash, current_hash,
       CASE WHEN baseline_hash IS NULL THEN 'new' WHEN current_hash IS NULL THEN 'gone'
            WHEN baseline_hash = current_hash THEN 'same' ELSE 'changed' END AS status
FROM b FULL OUTER JOIN c USING (session_id, intent_key)""")(_session_drift)
