"""DuckDB SQL for the correctness check.

Each query in ``canopy.plans.catalog`` has an independent statement here that
DuckDB runs on the same parquet views.  The statements re-derive the fixtures
from the base tables with the same rules and re-state every audit rule in
plain SQL (list functions instead of regex look-arounds, which RE2 lacks).
"""

from __future__ import annotations

import re

import unicodedata

from canopy.functions import dims
from canopy.sources import fixtures as FX

WS = dims.PY_WHITESPACE


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(vals: list[str]) -> str:
    return "[" + ", ".join(q(v) for v in vals) + "]"


def fill(template: str, **values: str) -> str:
    """A fixed text with its {names} replaced by SQL expressions."""
    parts = re.split(r"\{(\w+)\}", template)
    return " || ".join(values[p] if i % 2 else q(p) for i, p in enumerate(parts) if p)


def gate_text(column: str, text: str = "text", verb: str = "verb", kind: str = "intent_type") -> str:
    """A quarantined row's text; NULL for passed rows."""
    cases = " ".join(f"WHEN {q(c)} THEN {fill(t[column], text=text, verb=verb, type=kind)}"
                     for c, t in dims.GATE_TEXTS.items())
    return f"CASE confidence {cases} END"


def strip_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def requests_cte() -> str:
    n, a = len(FX.PHRASES), len(FX.ALIASES)
    # NFKC of the stripped literal is a constant of the fixture
    norm = [unicodedata.normalize("NFKC", p.strip()) for p in FX.PHRASES]
    return f"""requests AS (
  SELECT o_orderkey AS req_id, o_custkey AS session_id, o_orderdate AS ts,
         {sql_list(FX.PHRASES)}[(o_orderkey % {n}) + 1] AS text,
         {sql_list(norm)}[(o_orderkey % {n}) + 1] AS norm_src,
         {sql_list(FX.ALIASES)}[((o_orderkey // {n}) % {a}) + 1] AS alias
  FROM orders)"""


def documents_cte() -> str:
    # NFKC leaves every document text unchanged (checked on the test data)
    return """requests AS (
  SELECT doc_id AS req_id, source AS session_id, NULL::TIMESTAMP AS ts, text,
         text AS norm_src, 'javascript' AS alias
  FROM documents)"""


def language_case(x: str) -> str:
    whens = " ".join(f"WHEN {q(a)} THEN {q(l)}" for a, l in dims.LANGUAGE_ALIASES)
    return f"CASE lower({strip_sql(x)}) {whens} END"


def ingested_cte(src: str = "requests") -> str:
    marks = " OR ".join(f"contains(lower(norm_text), {q(m)})" for m in dims.SPEC_MARKERS)
    return f"""ing0 AS (
  SELECT *, {language_case('alias')} AS language, {strip_sql('norm_src')} AS norm_text
  FROM {src}),
ingested AS (
  SELECT *, CASE WHEN {marks} THEN 'yaml_spec' ELSE 'freetext' END AS source,
         CASE WHEN language IS NULL THEN 'Unsupported language: ' || alias
              WHEN length(norm_text) < 3 THEN 'Intent too short' ELSE 'ok' END AS status
  FROM ing0)"""


def verb_case(l: str, table=dims.VERB_SYNONYMS) -> str:
    parts = []
    for v, syns in table:
        cond = " OR ".join(f"contains({l}, {q(s)})" for s in syns)
        parts.append(f"WHEN {cond} THEN {q(v)}")
    return "CASE " + " ".join(parts) + " ELSE 'unknown' END"


def noun_expr(l: str, verb: str, table=dims.VERB_SYNONYMS) -> str:
    syn = " ".join(f"WHEN {q(v)} THEN {sql_list(s)}" for v, s in table)
    excl = f"list_concat({sql_list(dims.FILLER_WORDS)}, CASE {verb} {syn} ELSE []::VARCHAR[] END)"
    tok = (f"list_filter(regexp_extract_all({l}, '[a-z]+'), "
           f"lambda w: length(w) > 2 AND NOT list_contains({excl}, w))[1]")
    dflt = " ".join(f"WHEN {q(v)} THEN {q(dims.DEFAULT_NOUNS.get(v, 'Unknown'))}" for v, _ in table)
    return (f"CASE WHEN {tok} IS NOT NULL THEN upper(substr({tok}, 1, 1)) || substr({tok}, 2) "
            f"ELSE CASE {verb} {dflt} ELSE 'Unknown' END END")


def canonical_cte(src: str = "ingested", table=dims.VERB_SYNONYMS, name="canonical") -> str:
    return f"""{name}_0 AS (
  SELECT *, lower(norm_text) AS l FROM {src} WHERE status = 'ok' AND source = 'freetext'),
{name}_1 AS (SELECT *, {verb_case('l', table)} AS verb FROM {name}_0),
{name} AS (SELECT * EXCLUDE (l), {noun_expr('l', 'verb', table)} AS noun FROM {name}_1)"""


def matches_expr(raw: str, verb: str) -> str:
    d = dims
    words = f"string_split_regex(lower({raw}), '{WS}+')"

    def any_word(vals):
        return f"list_has_any({words}, {sql_list(vals)})"

    def vin(vals):
        return f"{verb} IN ({', '.join(q(v) for v in vals)})"

    cls = " OR ".join(f"contains(lower({raw}), {q(k)})" for k in d.CLASS_KEYWORDS)
    rules = [
        ("PURE_FUNCTION", vin([v for v in d.PURE_VERBS if v not in d.IO_VERBS])),
        ("PREDICATE", f"{any_word(d.PREDICATE_KEYWORDS)} OR {verb} = 'validate'"),
        ("TRANSFORMER", f"{verb} = 'transform'"),
        ("AGGREGATOR", f"({any_word(d.COLLECTION_NOUNS)} AND {any_word(d.AGGREGATOR_KEYWORDS)}) "
                       f"OR ({vin(['add', 'calculate'])} AND {any_word(d.COLLECTION_NOUNS)})"),
        ("SIDE_EFFECT_OP", vin(d.SIDE_EFFECT_VERBS)),
        ("CLASS_METHOD", cls),
        ("ASYNC_OPERATION", f"{verb} = 'fetch' OR {any_word(d.ASYNC_KEYWORDS)}"),
        ("DATA_CONTRACT", f"{verb} = 'define' OR ({any_word(d.DATA_CONTRACT_KEYWORDS)} AND NOT "
                          f"{vin(d.PURE_VERBS + d.SIDE_EFFECT_VERBS + ['fetch', 'validate', 'transform'])})"),
    ]
    arr = ", ".join(f"CASE WHEN {c} THEN {q(t)} END" for t, c in rules)
    return f"list_filter([{arr}], lambda x: x IS NOT NULL)"


def classified_cte(src: str = "canonical", name: str = "classified") -> str:
    return f"""{name}_0 AS (SELECT *, {matches_expr('text', 'verb')} AS matches FROM {src}),
{name} AS (
  SELECT *, coalesce(matches[1], 'PURE_FUNCTION') AS intent_type,
         CASE len(matches) WHEN 0 THEN 'LOW' WHEN 1 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence,
         md5(verb || ':' || noun || ':' || language || ':' || coalesce(matches[1], 'PURE_FUNCTION'))
           AS intent_key
  FROM {name}_0)"""


def snake_sql(x: str) -> str:
    s = f"lower(regexp_replace({x}, '([A-Z])', '_\\1', 'g'))"
    return f"regexp_replace(regexp_replace({s}, '^_+', ''), '__+', '_', 'g')"


def function_name_sql(t="intent_type", v="verb", n="noun", lang="language") -> str:
    base = (f"CASE {t} WHEN 'PURE_FUNCTION' THEN CASE WHEN coalesce({n}, '') <> '' THEN "
            f"lower(substr({n}, 1, 1)) || substr({n}, 2) ELSE 'result' END "
            f"WHEN 'PREDICATE' THEN 'is' || {n} WHEN 'TRANSFORMER' THEN 'to' || {n} "
            f"WHEN 'AGGREGATOR' THEN 'reduce' || {n} ELSE {v} || {n} END")
    return (f"CASE WHEN {t} = 'DATA_CONTRACT' THEN CASE WHEN coalesce({n}, '') <> '' THEN {n} "
            f"ELSE 'Unknown' END WHEN {lang} = 'python' THEN {snake_sql(base)} ELSE {base} END")


def pipeline(src_cte: str) -> str:
    return ",\n".join([src_cte, ingested_cte(), canonical_cte(), classified_cte()])


def mixed_cte() -> str:
    """Requests of both branches with their classification or error (``classify_all``)."""
    n = len(FX.SPEC_TEXTS)
    texts = [*FX.SPEC_TEXTS, *[p for p in FX.PHRASES if "intent:" in p]]
    rows = [*SPEC_RESULTS, *[("yaml_spec", None, None, None, None, "Invalid spec format")
                             for p in FX.PHRASES if "intent:" in p]]
    meaning = ", ".join("(" + ", ".join("NULL" if x is None else q(x) for x in (t, *r[1:])) + ")"
                        for t, r in zip(texts, rows, strict=True))
    return f"""{requests_cte().replace("requests AS", "free_requests AS", 1)},
requests AS (
  SELECT req_id, session_id, ts, text, norm_src, alias FROM free_requests
  UNION ALL
  SELECT -o_orderkey, o_custkey, o_orderdate, t, t, 'js'
  FROM (SELECT *, {sql_list(FX.SPEC_TEXTS)}[(o_orderkey % {n}) + 1] AS t FROM orders)),
{ingested_cte()}, {canonical_cte()}, {classified_cte()},
meaning(text, intent_type, verb, noun, language, error) AS (VALUES {meaning}),
every AS (
  SELECT req_id, session_id, ts, source, language, verb, noun, intent_type, confidence,
         intent_key, NULL AS error, false AS rejected
  FROM classified
  UNION ALL
  SELECT i.req_id, i.session_id, i.ts, 'yaml_spec', m.language, m.verb, m.noun, m.intent_type,
         CASE WHEN m.error IS NULL THEN 'HIGH' END,
         md5(m.verb || ':' || m.noun || ':' || m.language || ':' || m.intent_type), m.error, false
  FROM ingested i JOIN meaning m USING (text) WHERE i.status = 'ok' AND i.source <> 'freetext'
  UNION ALL
  SELECT req_id, session_id, ts, source, NULL, NULL, NULL, NULL, NULL, NULL, status, true
  FROM ingested WHERE status <> 'ok')"""


def mixed_attempts_cte() -> str:
    return attempts_cte().replace("attempts AS", "own_attempts AS", 1) + """,
attempts AS (
  SELECT * FROM own_attempts
  UNION ALL
  SELECT * REPLACE (-req_id AS req_id) FROM own_attempts WHERE req_id % 5 <> 0)"""


def attempts_cte() -> str:
    n = len(FX.REPLY_TEMPLATES)
    tpl = "((o_orderkey * 7 + a.attempt * 3 * (o_orderkey % 3)) % {n})".format(n=n)
    return f"""attempts AS (
  SELECT o_orderkey AS req_id, o_custkey AS session_id, o_orderdate AS ts, a.attempt,
         {tpl}::INTEGER AS tpl_id,
         replace({sql_list(FX.REPLY_TEMPLATES)}[{tpl} + 1], '__N__',
                 (o_orderkey // {FX.ROWS_PER_VALUE})::VARCHAR) AS raw
  FROM orders, (VALUES (1), (2), (3)) AS a(attempt))"""


def validated_cte(src: str = "attempts") -> str:
    req = sql_list(dims.REQUIRED_SECTIONS)
    st = strip_sql("p[i + 1]")
    imports = " OR ".join(f"regexp_matches(code0, '{r}')" for r in (
        "(?m)^\\s*import\\s+", "(?m)^\\s*from\\s+\\S+\\s+import\\s+", "(?m)^\\s*require\\s*\\("))
    return f"""sec0 AS (SELECT *, string_split(raw, '---') AS p FROM {src}),
sec1 AS (SELECT *, list_filter(list_transform(range(2, len(p)),
            lambda i: {{'section': p[i], 'body': {st}}}),
            lambda s: regexp_full_match(s.section, '\\w+')) AS found FROM sec0),
sec2 AS (SELECT *, list_transform(found, lambda s, k: {{'pos': k - 1, 'section': s.section,
            'body': s.body}}) AS numbered FROM sec1),
sec3 AS (SELECT * EXCLUDE (p, found), list_filter(numbered, lambda s, k: NOT list_contains(
            list_transform(numbered[k + 1:], lambda o: o.section), s.section)) AS secs
         FROM sec2),
v0 AS (SELECT *, list_transform(secs, lambda s: s.section) AS names,
              list_filter(secs, lambda s: s.section = 'IMPLEMENTATION')[1].body AS impl FROM sec3),
v1 AS (SELECT *, (length(impl) - length(replace(impl, '```', ''))) // 3 AS fences,
              {strip_sql("regexp_replace(impl, '```\\w*\\n?', '', 'g')")} AS code0 FROM v0),
validated AS (SELECT *, CASE
    WHEN contains(raw, '---AMBIGUITY---') THEN 'ambiguity'
    WHEN len(secs) = 0 THEN 'no_sections'
    WHEN NOT list_has_all(names, {req}) THEN 'missing_section'
    WHEN fences < 2 THEN 'fence_missing'
    WHEN fences > 2 THEN 'fence_multiple'
    WHEN code0 = '' THEN 'empty_code'
    WHEN {imports} THEN 'import'
    ELSE 'ok' END AS status,
  CASE WHEN NOT contains(raw, '---AMBIGUITY---') AND len(secs) > 0
       THEN list_filter({req}, lambda n: NOT list_contains(names, n))[1] END AS detail,
  CASE WHEN fences = 2 THEN code0 END AS code
  FROM v1),
hashed AS (SELECT *, CASE status WHEN 'ok' THEN substr(sha256(code), 1, 16)
                                 WHEN 'ambiguity' THEN '' END AS content_hash FROM validated),
sections AS (SELECT req_id, attempt, session_id, ts, content_hash,
    list_filter(secs, lambda s: s.section = 'INTENT_CLASSIFICATION')[1].body AS intent_classification,
    list_filter(secs, lambda s: s.section = 'SIGNATURE')[1].body AS signature,
    code AS implementation,
    list_filter(secs, lambda s: s.section = 'INVARIANTS')[1].body AS invariants,
    list_filter(secs, lambda s: s.section = 'TEST_ORACLE')[1].body AS test_oracle,
    list_filter(secs, lambda s: s.section = 'DEPENDENCIES')[1].body AS dependencies
  FROM hashed WHERE status = 'ok'),
results AS (
  SELECT req_id,
    coalesce(arg_min(status, attempt) FILTER (WHERE status IN ('ok', 'ambiguity') AND attempt <= 3),
             'failed') AS status,
    min(attempt) FILTER (WHERE status IN ('ok', 'ambiguity') AND attempt <= 3) AS attempt,
    coalesce(min(attempt) FILTER (WHERE status IN ('ok', 'ambiguity') AND attempt <= 3),
             least(max(attempt) FILTER (WHERE attempt <= 3), 3)) AS attempts_used,
    coalesce(arg_min(content_hash, attempt) FILTER (WHERE status IN ('ok', 'ambiguity')
             AND attempt <= 3), '') AS content_hash,
    CASE WHEN count(*) FILTER (WHERE status IN ('ok', 'ambiguity') AND attempt <= 3) = 0
         THEN 'Schema validation failed after 3 attempts' END AS error
  FROM hashed GROUP BY req_id)"""


def results_seq_cte() -> str:
    v0, v1 = FX.HASH_VARIANTS
    return f"""results AS (
  SELECT o_orderkey AS req_id, CASE WHEN o_orderkey % 5 = 0 THEN 0
         ELSE o_orderkey // {FX.ROWS_PER_SESSION} END AS session_id, o_orderdate AS ts,
         md5('add:N' || (o_orderkey % 5)::VARCHAR || ':python:PURE_FUNCTION') AS intent_key,
         CASE WHEN o_orderkey % 31 = 0 THEN '' WHEN o_orderkey % 97 = 0 THEN {q(v1)} ELSE {q(v0)} END AS content_hash,
         CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END AS is_reset
  FROM orders),
sessioned AS (
  SELECT *, sum(is_reset) OVER (PARTITION BY session_id ORDER BY ts, req_id
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT
            AS session_no
  FROM results),
firsts AS (SELECT session_id, session_no, intent_key,
                  arg_min(content_hash, (ts, req_id)) FILTER (WHERE content_hash <> '') AS expected
           FROM sessioned GROUP BY ALL),
checked AS (SELECT s.*, CASE WHEN s.content_hash <> '' THEN f.expected END AS expected,
                   s.content_hash <> '' AND s.content_hash <> f.expected AS violation
            FROM sessioned s JOIN firsts f USING (session_id, session_no, intent_key))"""


def runs_cte() -> str:
    t = f"{sql_list(dims.TYPES)}[(l_partkey % {len(dims.TYPES)}) + 1]"
    l0 = f"{sql_list(dims.LANGUAGES)}[(l_suppkey % {len(dims.LANGUAGES)}) + 1]"
    return f"""runs0 AS (
  SELECT l_orderkey * 100 + l_linenumber AS call_id, {t} AS type,
         CASE WHEN {t} = 'CLASS_METHOD' AND {l0} = 'go' THEN 'typescript' ELSE {l0} END AS language,
         (l_linenumber % 4)::INTEGER AS phrasing, (l_orderkey % 5)::INTEGER AS run
  FROM lineitem),
runs AS (
  SELECT *, CASE WHEN type = 'PREDICATE' AND language = 'python' AND phrasing = 3
                 THEN 'drift' || substr(substr(sha256(type || ':' || language), 1, 16), 6, 11)
                 ELSE substr(sha256(type || ':' || language), 1, 16) END AS content_hash
  FROM runs0)"""


def log_cte() -> str:
    k = "json_extract_string(props, '$.k')::BIGINT"
    trace = "'t' || user_id::VARCHAR"
    span = "hex(event_id)"
    ops = sql_list(dims.SPAN_OPERATIONS)
    n_ops = len(dims.SPAN_OPERATIONS)
    h0, h1 = FX.SYSTEM_PROMPT_HASHES
    return f"""log AS (
  SELECT 'llm_call_start' AS event, {trace} AS trace_id, {span} AS span_id, ts AS ts,
         {trace} AS session_id,
         CASE WHEN event_id % 307 = 0 THEN {q(FX.OFF_PIN_MODEL)} ELSE {q(dims.PINNED_MODEL)} END
           AS model,
         CASE WHEN event_id % 501 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS temperature,
         {dims.PINNED_MAX_TOKENS}::BIGINT AS max_tokens,
         CASE WHEN event_id % 997 = 0 THEN {q(h1)} ELSE {q(h0)} END AS system_prompt_hash,
         (event_id % 3 + 1)::BIGINT AS attempt, NULL::BIGINT AS tokens_in, NULL::BIGINT AS tokens_out,
         NULL::DOUBLE AS latency_ms, NULL::VARCHAR AS operation, NULL::VARCHAR AS content_hash
  FROM events WHERE event_id % 1000 NOT IN (7, 13, 17)
  UNION ALL
  SELECT 'llm_call_complete', {trace}, {span},
         make_timestamp(epoch_us(ts) + round(value * 10 * 1000)::BIGINT), {trace},
         NULL, NULL, NULL, NULL, (event_id % 3 + 1)::BIGINT, {k} * 10, {k}, value * 10, NULL,
         substr(sha256(props), 1, 16)
  FROM events, (VALUES (0), (1)) AS again(k)  -- some completions are delivered twice
  WHERE event_id % 11 <> 0 AND (k = 0 OR event_id % 41 = 0)
  UNION ALL
  SELECT 'span_completed', {trace}, 'op-' || hex(event_id), ts, {trace},
         NULL, NULL, NULL, NULL, NULL, NULL, NULL, value, {ops}[(event_id % {n_ops}) + 1], NULL
  FROM events),
starts AS (SELECT trace_id, span_id, session_id, ts AS start_ts, model, temperature, max_tokens,
                  system_prompt_hash, attempt FROM log WHERE event = 'llm_call_start'),
dones AS (SELECT DISTINCT trace_id, span_id, ts AS end_ts, tokens_in, tokens_out, latency_ms, content_hash
          FROM log WHERE event = 'llm_call_complete'),
calls AS (SELECT * FROM starts JOIN dones USING (trace_id, span_id))"""


# FIXED VALUES: the JSON meaning of the project specs that are YAML or repeat a key (the last
# three of the fixture; the third is broken), and the loader's text for the broken one
PROJECT_SPECS_AS_JSON = [
    '{"project": {"name": "yaml-__ID__", "language": "python", "data_contracts": ['
    '{"name": "User", "fields": {"id": "string"}}], "modules": [{"name": "store", "functions": ['
    '"save User record", "load config"]}]}}',
    '{"project": {"name": "last-__ID__", "language": "go", "modules": ['
    '{"name": "a", "functions": ["f"]}]}}',
]
YAML_ERROR = ("Invalid YAML: while parsing a flow sequence\n  in \"<unicode string>\", line 2, "
              "column 5:\n      - [broken\n        ^\nexpected ',' or ']', but got '<stream end>'\n"
              "  in \"<unicode string>\", line 2, column 12:\n      - [broken\n               ^")

# FIXED VALUES: what each spec text of the fixture means:
# source, intent_type, verb, noun, language, error
SPEC_RESULTS = [
    ("yaml_spec", "PURE_FUNCTION", "add", "Total", "javascript", None),
    ("json_spec", "PREDICATE", "validate", "EvenNumber", "javascript", None),
    ("yaml_spec", "AGGREGATOR", "sum", "Orders", "python", None),
    ("yaml_spec", None, None, None, None, "Missing required field: verb"),
    ("yaml_spec", None, None, None, None, "Missing required field: intent"),
    ("yaml_spec", None, None, None, None, "Unknown intent type: unknown_type"),
    ("yaml_spec", None, None, None, None, "Unsupported language: rust"),
    ("yaml_spec", None, None, None, None, "Invalid spec format: expected a mapping"),
    ("json_spec", "DATA_CONTRACT", "define", "User", "go", None),
    ("json_spec", None, None, None, None, "Missing required field: intent"),
    ("json_spec", None, None, None, None, "Missing required field: noun"),
    ("json_spec", None, None, None, None, "Unsupported language: java"),
    ("json_spec", "PREDICATE", "validate", "Age", "go", None),
    ("yaml_spec", None, None, None, None, "Invalid spec format: month must be in 1..12"),
    ("yaml_spec", None, None, None, None, "Field must be text: intent"),
    ("json_spec", None, None, None, None, "Field must be text: verb"),
    ("yaml_spec", None, None, None, None, "Field must be text: noun"),
    ("yaml_spec", None, None, None, None, "Field must be text: language"),
    ("json_spec", None, None, None, None, "Field must be text: intent"),
]
# FIXED VALUES: banned parameter names of the definitions in each reply template
PARAMETER_FINDINGS = [
    (1, "implementation", "x"), (1, "implementation", "y"), (8, "signature", "items"),
    (8, "implementation", "items"), (8, "implementation", "x"), (8, "implementation", "y"),
    (9, "signature", "uid"), (9, "implementation", "uid"), (9, "implementation", "x"),
    (10, "implementation", "arr"),
]
#: The spec texts with a repeated key replaced by the key that counts.
SPEC_TEXTS = [s.replace('"verb": "check", ', "") for s in FX.SPEC_TEXTS]


def projects_cte() -> str:
    n = len(FX.PROJECT_SPECS)
    specs = sql_list([s for s in FX.PROJECT_SPECS if s.startswith(("{", "["))][:16]
                     + PROJECT_SPECS_AS_JSON)[:-1] + ", NULL]"
    st = strip_sql
    supported = "[" + ", ".join(f"'{x}'" for x in sorted(dims.PROJECT_LANGUAGES)) + "]"
    err = {k: lambda _t=t, **values: fill(_t, **values) for k, t in dims.PROJECT_ERRORS.items()}
    langs = ", ".join(q(x) for x in dims.PROJECT_LANGUAGES)

    def req(obj, key, ctx_sql):
        v = f"json_extract({obj}, '$.{key}')"
        values = {"key": q(key), "place": ctx_sql}
        return (f"WHEN {v} IS NULL THEN {err['missing_field'](**values)} "
                f"WHEN json_type({v}) <> 'VARCHAR' OR {st(f'json_extract_string({obj}, {q(chr(36) + chr(46) + key)})')} = '' "
                f"THEN {err['empty_field'](**values)} ")

    e_name = st("json_extract_string(e, '$.name')")
    lang = f"lower({st(chr(106) + 'son_extract_string(proj, ' + q('$.language') + ')')})"
    return f"""pspec AS (
  SELECT s_suppkey AS project_id,
         replace({specs}[(s_suppkey % {n}) + 1], '__ID__', s_suppkey::VARCHAR)
           AS spec FROM supplier),
pq AS (SELECT project_id, spec, json_extract(spec, '$.project') AS proj FROM pspec),
ptop AS (SELECT project_id, (0, -1, -1) AS ord, CASE
    WHEN spec IS NULL THEN {q(YAML_ERROR)}
    WHEN json_type(spec) <> 'OBJECT' THEN {q(dims.PROJECT_ERRORS["not_a_mapping"])}
    WHEN proj IS NULL THEN {err["no_project"]()}
    WHEN json_type(proj) <> 'OBJECT' THEN {q(dims.PROJECT_ERRORS["project_kind"])}
    {req('proj', 'name', "'project'")}
    {req('proj', 'language', "'project'")}
    WHEN {lang} NOT IN ({langs}) THEN {err["language"](language=lang, supported=q(supported))}
    WHEN json_extract(proj, '$.data_contracts') IS NOT NULL
         AND json_type(json_extract(proj, '$.data_contracts')) <> 'ARRAY'
      THEN {q(dims.PROJECT_ERRORS["contracts_kind"])}
  END AS error FROM pq),
pok AS (SELECT pq.* FROM pq JOIN ptop USING (project_id) WHERE ptop.error IS NULL),
ce AS (SELECT project_id, proj, unnest(range(json_array_length(json_extract(proj, '$.data_contracts'))::BIGINT))
         AS c_pos FROM pok WHERE json_type(json_extract(proj, '$.data_contracts')) = 'ARRAY'),
ce2 AS (SELECT project_id, c_pos, json_extract(proj, '$.data_contracts[' || c_pos || ']') AS e,
               list_transform(json_extract(proj, '$.data_contracts[*]'),
                 lambda x: {st("json_extract_string(x, '$.name')")}) AS names FROM ce),
cerr AS (SELECT project_id, (1, c_pos, -1) AS ord, CASE
    WHEN json_type(e) <> 'OBJECT' THEN {err["entry_kind"](place="'data_contracts[' || c_pos || ']'")}
    {req('e', 'name', "'data_contracts[' || c_pos || ']'")}
    WHEN list_position(names, {st("json_extract_string(e, '$.name')")}) < c_pos + 1
      THEN {err["repeated_contract"](name=e_name)}
    WHEN json_type(json_extract(e, '$.fields')) IS DISTINCT FROM 'OBJECT'
         OR len(json_keys(json_extract(e, '$.fields'))) = 0
      THEN {err["no_fields"](place="'data_contracts[' || c_pos || ']'", name=e_name)}
  END AS error FROM ce2),
merr0 AS (SELECT project_id, (2, -1, -1) AS ord, CASE WHEN json_extract(proj, '$.modules') IS NOT NULL
    AND json_type(json_extract(proj, '$.modules')) <> 'ARRAY' THEN {q(dims.PROJECT_ERRORS["modules_kind"])} END
    AS error FROM pok),
me AS (SELECT project_id, proj, unnest(range(json_array_length(json_extract(proj, '$.modules'))::BIGINT))
         AS m_pos FROM pok WHERE json_type(json_extract(proj, '$.modules')) = 'ARRAY'),
me2 AS (SELECT project_id, m_pos, json_extract(proj, '$.modules[' || m_pos || ']') AS e,
               list_transform(json_extract(proj, '$.modules[*]'),
                 lambda x: {st("json_extract_string(x, '$.name')")}) AS names FROM me),
merr AS (SELECT project_id, m_pos, e, (3, m_pos, -1) AS ord, CASE
    WHEN json_type(e) <> 'OBJECT' THEN {err["entry_kind"](place="'modules[' || m_pos || ']'")}
    {req('e', 'name', "'modules[' || m_pos || ']'")}
    WHEN list_position(names, {st("json_extract_string(e, '$.name')")}) < m_pos + 1
      THEN {err["repeated_module"](name=e_name)}
    WHEN json_type(json_extract(e, '$.functions')) IS DISTINCT FROM 'ARRAY'
         OR json_array_length(json_extract(e, '$.functions')) = 0
      THEN {err["no_functions"](place="'modules[' || m_pos || ']'", name=e_name)}
  END AS error FROM me2),
fe AS (SELECT project_id, m_pos, {st("json_extract_string(e, '$.name')")} AS module, e,
              unnest(range(json_array_length(json_extract(e, '$.functions'))::BIGINT)) AS f_pos
       FROM merr WHERE error IS NULL),
fe2 AS (SELECT *, json_extract(e, '$.functions[' || f_pos || ']') AS f FROM fe),
ferr AS (SELECT project_id, (3, m_pos, f_pos) AS ord, CASE
    WHEN json_type(f) = 'OBJECT' THEN CASE
      {req('f', 'intent', "'modules[' || m_pos || '].functions[' || f_pos || ']'")} END
    WHEN json_type(f) <> 'VARCHAR' THEN {err["function_kind"](
      place="'modules[' || m_pos || '].functions[' || f_pos || ']'")} END AS error FROM fe2),
pempty AS (SELECT project_id, (9, -1, -1) AS ord, CASE WHEN
    coalesce(json_array_length(json_extract(proj, '$.data_contracts')), 0) = 0 AND
    coalesce(json_array_length(json_extract(proj, '$.modules')), 0) = 0
    THEN {err["empty_project"]()} END AS error FROM pok),
pcand AS (SELECT project_id, ord, error FROM ptop UNION ALL SELECT project_id, ord, error FROM cerr
          UNION ALL SELECT * FROM merr0 UNION ALL SELECT project_id, ord, error FROM merr
          UNION ALL SELECT * FROM ferr UNION ALL SELECT * FROM pempty),
pviol AS (SELECT project_id, arg_min(error, ord) AS error FROM pcand WHERE error IS NOT NULL
          GROUP BY project_id),
pgood AS (SELECT * FROM pq WHERE project_id NOT IN (SELECT project_id FROM pviol)),
pfun AS (
  SELECT g.project_id, {lang.replace('proj', 'g.proj')} AS project_language, fe2.m_pos, fe2.module,
         fe2.f_pos,
         coalesce({st("json_extract_string(fe2.f, '$.intent')")},
                  CASE WHEN json_type(fe2.f) = 'VARCHAR' THEN {st("(fe2.f ->> '$')")} END) AS intent,
         lower({st("json_extract_string(fe2.f, '$.language')")}) AS language_override
  FROM pgood g JOIN fe2 USING (project_id)),
pcon AS (
  SELECT g.project_id, {lang.replace('proj', 'g.proj')} AS language, c.c_pos,
         {st("json_extract_string(c.e, '$.name')")} AS contract,
         coalesce(json_extract_string(c.e, '$.description'), '') AS description,
         array_to_string(list_transform(json_keys(json_extract(c.e, '$.fields')),
           lambda k: k || ': ' || json_extract_string(json_extract(c.e, '$.fields'), '$."' || k || '"')),
           ', ') AS field_text
  FROM pgood g JOIN ce2 c USING (project_id)),
pedges AS (
  SELECT DISTINCT f.project_id, f.module || ':' || f.intent AS key, 'contract:' || c.contract AS dep
  FROM pfun f JOIN pcon c ON f.project_id = c.project_id
   AND contains(lower(f.intent), lower(c.contract))),
pitems0 AS (
  SELECT project_id, 'contract:' || contract AS key,
         'define ' || contract || ' type with fields ' || field_text ||
           CASE WHEN description <> '' THEN '. ' || description ELSE '' END AS intent,
         language, NULL::VARCHAR AS module, 0 AS k, c_pos AS a, 0 AS b FROM pcon
  UNION ALL
  SELECT project_id, module || ':' || intent, intent, coalesce(language_override, project_language),
         module, 1, m_pos, f_pos FROM pfun),
pitems AS (
  SELECT project_id, key, arg_max(intent, (k, a, b)) AS intent, arg_max(language, (k, a, b)) AS language,
         arg_max(module, (k, a, b)) AS module FROM pitems0 GROUP BY project_id, key)"""


def conversations_cte() -> str:
    # NFKC leaves every conversation text unchanged (checked on the test data)
    return """requests AS (
  SELECT conv_id::VARCHAR || ':' || turn::VARCHAR AS req_id, conv_id AS session_id, NULL::TIMESTAMP AS ts, text,
         text AS norm_src, 'javascript' AS alias
  FROM conversations WHERE role = 'user')"""
