"""Audit inputs derived from the given tables.

The driver's tables are TPC-H-like; the audited system works on requests,
replies and call logs.  Each fixture here is a pure projection (no shuffle) of a
given table that assigns one of a small set of literal phrases / replies to
every row by a rule on the row key, so its size grows with the table.  The
same rules are written in DuckDB SQL in ``canopy.plans.oracle_sql``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.session import table

# ---------------------------------------------------------------------------
# FIXED VALUES: test phrases and reply templates (taken from the audited
# system's own test cases); order is the assignment rule, do not reorder
# ---------------------------------------------------------------------------
PHRASES: list[str] = [
    "write add function",
    "make a sum method",
    "create a function to add two numbers",
    "combine two numbers",
    "I need addition",
    "subtract two numbers",
    "remove from list",
    "check if even",
    "is it a valid email",
    "convert user to DTO",
    "transform and save data",
    "count active users",
    "sum all order totals",
    "filter items by status",
    "save user to database",
    "delete the record",
    "fetch user profile",
    "stream events from queue",
    "define a User type",
    "schema for AuthToken",
    "frobnicate the data",
    "the target address",
    "is the data fetch complete",
    "calculate the total amount",
    "ａｄｄ two numbers",
    "ab",
    "intent: pure_function verb: add",
    "add orders together",
]
ALIASES: list[str] = [
    "js", "javascript", "ts", "typescript", "py", "python", "python3", "go", "golang", "rust",
]
MULTI_PHRASES: list[str] = [
    "write add function",
    "make a calculator",
    "build a crud module",
    "check if even number",
    "write add and subtract functions",
    "create add function and validate input",
    "write add function, create subtract function",
    "1. add two numbers 2. check if even",
]
REPLY = """
---INTENT_CLASSIFICATION---
type: PURE_FUNCTION
confidence: HIGH

---SIGNATURE---
javascript: const total = (firstNumber, secondNumber) => firstNumber + secondNumber

---IMPLEMENTATION---
```javascript
const total = (firstNumber, secondNumber) => firstNumber + secondNumber;
```

---INVARIANTS---
preconditions:
  - finite

---TEST_ORACLE---
```javascript
assert(total(1, 2) === 3);
assert(total(0, 0) === 0);
assert(total(-1, 1) === 0);
```
---
"""
_IMPL = "const total = (firstNumber, secondNumber) => firstNumber + secondNumber;"
REPLY_TEMPLATES: list[str] = [
    REPLY,
    REPLY.replace(_IMPL, "const total = (x, y) => x + y;"),
    REPLY.replace("INVARIANTS", "invariants"),
    "\n---AMBIGUITY---\nunclear_dimension: verb\n---\n",
    "just some random text",
    REPLY.replace(_IMPL, _IMPL + "\n```\n```javascript\nconst b = 1;"),
    REPLY.replace(_IMPL, "import math\n" + _IMPL),
    REPLY + "\n---DEPENDENCIES---\n- axios\nnumpy as np\n",
]


def _reply(kind, confidence, verb, noun, signature, fence, code, invariants, tests, deps=""):
    return (f"---INTENT_CLASSIFICATION---\ntype: {kind}\nconfidence: {confidence}\n"
            f"canonical_verb: {verb}\ncanonical_noun: {noun}\n\n---SIGNATURE---\n{signature}\n\n"
            f"---IMPLEMENTATION---\n```{fence}\n{code}\n```\n\n---INVARIANTS---\n{invariants}\n\n"
            f"---TEST_ORACLE---\n```{fence}\n{tests}\n```\n"
            + (f"\n---DEPENDENCIES---\n{deps}\n" if deps else "---\n"))


# replies of this library's own: "__N__" becomes a value of the row, so hashes, records and
# modules grow with the table
REPLY_TEMPLATES += [
    _reply("AGGREGATOR", "HIGH", "sum", "Orders",
           "python: def reduce_orders(items, rate=max(1, 2), *rest) -> float", "python",
           "def reduce_orders_q__N__(items, rate=max(1, 2), *rest):\n"
           "    return fold(items, key=lambda x, y: combine(x, data))",
           "preconditions:\n  - items is a list\npostconditions:\n  - total of all items\n"
           "edge_cases:\n  - empty list gives 0",
           "assert reduce_orders_q__N__([]) == 0\nassert reduce_orders_q__N__([1]) == 1\n"
           "assert reduce_orders_q__N__([1, 2]) == 3", "- lib__N__\n- shared\npandas as pd"),
    _reply("SIDE_EFFECT_OP", "MEDIUM", "save", "User",
           "typescript: const saveUser = (user: User, { repository, uid = pick(a, b) }: Deps) => void",
           "typescript",
           "const saveUser__N__ = async (user: Map<string, number>, { repository, uid }: Deps) => {\n"
           "  await repository.save(user, list);\n  return check((x) => x.id);\n};",
           "preconditions:\n  - repository is injected\nedge_cases:\n  - see implementation",
           "assert(saved(1));\nassert(saved(2));\nmock.verify();", "- lib__N__\n- axios"),
    _reply("PREDICATE", "HIGH", "validate", "EvenNumber",
           "go: func isEvenNumber(value int) bool", "go",
           "func (r *Repo) isEvenNumber__N__(value int, arr []int) bool {\n"
           "\tif contains(data, value) {\n\t\treturn true\n\t}\n\treturn value%2 == 0\n}",
           "preconditions:\n  - value fits 64 bits\npostconditions:\n  - no side effects\n"
           "edge_cases:\n  - 0 is even",
           "assert(isEvenNumber(0))\nassert(!isEvenNumber(1))\nassert(isEvenNumber(2))"),
    _reply("PURE_FUNCTION", "LOW", "add", "Total",
           "javascript: function total(firstNumber, secondNumber)", "javascript",
           "function total__N__(firstNumber, secondNumber = f(x, y)) {\n"
           "  return max(firstNumber, n1) + secondNumber;\n}",
           "preconditions:\n  - finite numbers\npostconditions:\n  - sum\nedge_cases:\n  - 0",
           "assert(total(0, 0) === 0);\nassert(total(1, 2) === 3);\nassert(total(-1, 1) === 0);"),
]
# ---------------------------------------------------------------------------


ROWS_PER_VALUE = 64  # orders that share one value of a reply template


def pick(values: list[str], idx) -> F.Column:
    """``values[idx]`` as a literal-array lookup (projection, no join)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """requests(req_id, session_id, ts, text, alias): one request per order."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("req_id"),
        F.col("o_custkey").alias("session_id"),
        F.col("o_orderdate").alias("ts"),
        pick(PHRASES, k % len(PHRASES)).alias("text"),
        pick(ALIASES, F.floor(k / len(PHRASES)) % len(ALIASES)).alias("alias"),
    )


def document_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a free-text request (whole text, JavaScript target)."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("req_id"),
        F.col("source").alias("session_id"),
        F.lit(None).cast("timestamp").alias("ts"),
        F.col("text"),
        F.lit("javascript").alias("alias"),
        F.col("lang"),
    )


def conversation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn of a conversation as a request."""
    return (table(spark, sf_dir, "conversations")
            .where(F.col("role") == "user")
            .select(F.concat_ws(":", "conv_id", "turn").alias("req_id"),
                    F.col("conv_id").alias("session_id"),
                    F.lit(None).cast("timestamp").alias("ts"),
                    F.col("text"),
                    F.lit("javascript").alias("alias")))


def multi_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("req_id"), pick(MULTI_PHRASES, k % len(MULTI_PHRASES)).alias("text"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """attempts(req_id, session_id, ts, attempt, tpl_id, raw): three replies per order."""
    k = F.col("o_orderkey")
    a = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("attempt")
    base = table(spark, sf_dir, "orders").select(
        k.alias("req_id"), F.col("o_custkey").alias("session_id"),
        F.col("o_orderdate").alias("ts"), a)
    # every third request repeats one template on all attempts, so some exhaust the budget
    tpl = ((F.col("req_id") * 7 + F.col("attempt") * 3 * (F.col("req_id") % 3))
           % len(REPLY_TEMPLATES)).cast("int")
    return base.select(
        "req_id", "session_id", "ts", F.col("attempt").cast("int").alias("attempt"),
        tpl.alias("tpl_id"),
        F.replace(pick(REPLY_TEMPLATES, tpl), F.lit("__N__"),
                  F.floor(F.col("req_id") / ROWS_PER_VALUE).cast("string")).alias("raw"))


def mixed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of both branches: the free-text one of each order, and its spec-form one under
    the negated key."""
    k = F.col("o_orderkey")
    spec = table(spark, sf_dir, "orders").select(
        (-k).alias("req_id"), F.col("o_custkey").alias("session_id"),
        F.col("o_orderdate").alias("ts"), pick(SPEC_TEXTS, k % len(SPEC_TEXTS)).alias("text"),
        F.lit("js").alias("alias"))
    return requests(spark, sf_dir).unionByName(spec)


def mixed_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies to ``mixed_requests``; every fifth spec-form request was never answered."""
    att = attempts(spark, sf_dir)
    spec = att.where(F.col("req_id") % 5 != 0).withColumn("req_id", -F.col("req_id"))
    return att.unionByName(spec)


# ---------------------------------------------------------------------------
# FIXED VALUES: implementation hashes of reply templates 0 and 1
HASH_VARIANTS: list[str] = ["a2a69ff27caa2bdf", "62e46070ace177cd"]
ROWS_PER_SESSION = 64  # drift sessions; their number grows with the table
# ---------------------------------------------------------------------------


def results_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """results_seq(req_id, session_id, ts, intent_key, content_hash, is_reset)."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("req_id"),
        # a fifth of all rows are of one session
        F.when(k % 5 == 0, 0).otherwise(F.floor(k / ROWS_PER_SESSION)).cast("long")
        .alias("session_id"),
        F.col("o_orderdate").alias("ts"),
        F.md5(F.concat(F.lit("add:N"), (k % 5).cast("string"),
                       F.lit(":python:PURE_FUNCTION"))).alias("intent_key"),
        # an ambiguous reply has no hash
        F.when(k % 31 == 0, "").when(k % 97 == 0, HASH_VARIANTS[1])
        .otherwise(HASH_VARIANTS[0]).alias("content_hash"),
        F.when(k % 50 == 0, 1).otherwise(0).alias("is_reset"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """runs(call_id, type, language, phrasing, run, content_hash): one call per line item.

    Cell (go, CLASS_METHOD) never gets calls (they are sent as typescript);
    cell (python, PREDICATE) drifts on phrasing 3.
    """
    from canopy.functions import dims
    t = pick(dims.TYPES, F.col("l_partkey") % len(dims.TYPES))
    lang0 = pick(dims.LANGUAGES, F.col("l_suppkey") % len(dims.LANGUAGES))
    li = table(spark, sf_dir, "lineitem")
    base = li.select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("call_id"),
        t.alias("type"),
        F.when((t == "CLASS_METHOD") & (lang0 == "go"), "typescript").otherwise(lang0).alias("language"),
        (F.col("l_linenumber") % 4).cast("int").alias("phrasing"),
        (F.col("l_orderkey") % 5).cast("int").alias("run"))
    h = F.substring(F.sha2(F.concat_ws(":", "type", "language"), 256), 1, 16)
    drift = (F.col("type") == "PREDICATE") & (F.col("language") == "python") & (F.col("phrasing") == 3)
    return base.withColumn("content_hash", F.when(drift, F.concat(F.lit("drift"), F.substring(h, 6, 11)))
                           .otherwise(h))


# ---------------------------------------------------------------------------
# FIXED VALUES: call-log fixture settings
SYSTEM_PROMPT_HASHES: list[str] = ["5f0c6a1b2d3e4f70", "9a8b7c6d5e4f3a21"]
OFF_PIN_MODEL = "claude-sonnet-latest"
# ---------------------------------------------------------------------------


def log_lines(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """line(string): structured JSON log lines derived from ``events`` (or some rows of it).

    Per event: an ``llm_call_start`` line, an ``llm_call_complete`` line unless
    event_id % 11 = 0 (failed call), and a ``span_completed`` line.  A few start
    lines are corrupt (truncated, a value of a wrong type, a time that is none), and
    some completions are delivered twice.  Off-pin settings are planted by event id.
    """
    from canopy.functions import dims
    e = table(spark, sf_dir, "events") if events is None else events
    eid = F.col("event_id")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    trace = F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("trace_id")
    span = F.hex(eid).alias("span_id")
    tokens = F.get_json_object(F.col("props"), "$.k").cast("long")
    latency = F.col("value") * 10
    start = F.to_json(F.struct(
        F.lit("info").alias("level"), iso(F.col("ts")).alias("timestamp"),
        F.lit("llm_call_start").alias("event"), trace, span,
        F.when(eid % 307 == 0, F.lit(OFF_PIN_MODEL)).otherwise(F.lit(dims.PINNED_MODEL)).alias("model"),
        F.when(eid % 501 == 0, F.lit(0.5)).otherwise(F.lit(0.0)).alias("temperature"),
        F.lit(dims.PINNED_MAX_TOKENS).alias("max_tokens"),
        F.when(eid % 997 == 0, F.lit(SYSTEM_PROMPT_HASHES[1]))
        .otherwise(F.lit(SYSTEM_PROMPT_HASHES[0])).alias("system_prompt_hash"),
        F.concat(F.lit("Language target: javascript\nIntent type: "),
                 F.upper(F.col("event_type"))).alias("user_prompt"),
        (eid % 3 + 1).cast("int").alias("attempt")))
    complete = F.to_json(F.struct(
        F.lit("info").alias("level"),
        iso(F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp"))
                               + F.round(latency * 1000).cast("long"))).alias("timestamp"),
        F.lit("llm_call_complete").alias("event"), trace, span,
        F.substring(F.sha2(F.col("props"), 256), 1, 16).alias("content_hash"),
        F.lit("end_turn").alias("finish_reason"),
        (tokens * 10).alias("tokens_in"), tokens.alias("tokens_out"),
        latency.alias("latency_ms"), (eid % 3 + 1).cast("int").alias("attempt")))
    span_line = F.to_json(F.struct(
        F.lit("info").alias("level"), iso(F.col("ts")).alias("timestamp"),
        F.lit("span_completed").alias("event"), trace,
        F.concat(F.lit("op-"), F.hex(eid)).alias("span_id"),
        pick(dims.SPAN_OPERATIONS, eid % len(dims.SPAN_OPERATIONS)).alias("operation"),
        F.col("value").alias("latency_ms")))
    start = (F.when(eid % 1000 == 7, F.substring(start, 1, 40))
             .when(eid % 1000 == 13, F.regexp_replace(start, '"max_tokens":[0-9]+',
                                                      '"max_tokens":"lots"'))
             .when(eid % 1000 == 17, F.regexp_replace(start, '"timestamp":"[^"]+"',
                                                      '"timestamp":"not a time"'))
             .otherwise(start))
    lines = F.filter(F.array(start, F.when(eid % 11 != 0, complete),
                             F.when((eid % 41 == 0) & (eid % 11 != 0), complete), span_line),
                     lambda x: x.isNotNull())
    return e.select(F.explode(lines).alias("line"))


# ---------------------------------------------------------------------------
# FIXED VALUES: project specs (JSON form of the audited system's test specs);
# "__ID__" is replaced by the supplier key so that every project is distinct
PROJECT_SPECS: list[str] = [
    '{"project": {"name": "user-auth-__ID__", "language": "typescript", "data_contracts": ['
    '{"name": "User", "fields": {"id": "string", "email": "string"}}, '
    '{"name": "AuthToken", "fields": {"token": "string", "userId": "string"}}], "modules": ['
    '{"name": "validation", "functions": ["validate email format", "check if User exists"]}, '
    '{"name": "auth", "functions": ["hash password", "generate AuthToken for User"]}, '
    '{"name": "user", "functions": [{"intent": "create User in database", "language": "python"}, '
    '"fetch User by id"]}]}}',
    '{"project": {"name": "shared-types-__ID__", "language": "typescript", "data_contracts": ['
    '{"name": "User", "description": "Core user entity", "fields": {"id": "string", "name": "string"}}]}}',
    '{"project": {"name": "my-app-__ID__", "language": "ts", "modules": ['
    '{"name": "auth", "functions": ["hash password"]}]}}',
    '{"project": {"language": "typescript", "modules": [{"name": "a", "functions": ["f"]}]}}',
    '{"project": {"name": "bad-lang-__ID__", "language": "rust", "modules": ['
    '{"name": "a", "functions": ["f"]}]}}',
    '{"project": {"name": "dup-mod-__ID__", "language": "go", "modules": ['
    '{"name": "a", "functions": ["f"]}, {"name": "a", "functions": ["g"]}]}}',
    '{"project": {"name": "no-fields-__ID__", "language": "python", "data_contracts": ['
    '{"name": "User", "fields": {}}]}}',
    '{"project": {"name": "empty-fns-__ID__", "language": "python", "modules": ['
    '{"name": "a", "functions": []}]}}',
    '{"project": {"name": "bad-fn-__ID__", "language": "python", "modules": ['
    '{"name": "a", "functions": ["f", 42]}]}}',
    '{"project": {"name": "empty-__ID__", "language": "python"}}',
    '{"project": {"name": "dup-contract-__ID__", "language": "python", "data_contracts": ['
    '{"name": "User", "fields": {"id": "string"}}, {"name": "User", "fields": {"id": "int"}}]}}',
    '{"name": "no-project-__ID__"}',
    '{"project": "just a string"}',
    '["not", "a", "mapping"]',
    '{"project": {"name": "  ", "language": "go", "modules": [{"name": "a", "functions": ["f"]}]}}',
    '{"project": {"name": "bad-entry-__ID__", "language": "go", "modules": ["a"]}}',
    'project:\n  name: yaml-__ID__\n  language: python\n  data_contracts:\n'
    '    - name: User\n      fields:\n        id: string\n  modules:\n    - name: store\n'
    '      functions:\n        - save User record\n        - load config\n',
    '{"project": {"name": "first", "name": "last-__ID__", "language": "go", "modules": ['
    '{"name": "a", "functions": ["f"]}]}}',
    'project:\n  - [broken',
]
# ---------------------------------------------------------------------------


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """projects(project_id, spec_json): one project spec per supplier."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("project_id"),
        F.replace(pick(PROJECT_SPECS, k % len(PROJECT_SPECS)), F.lit("__ID__"),
                  k.cast("string")).alias("spec_json"))


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes(node), edges(src, dst)): every part depends on part // 2 (parts 2+),
    plus a two-node cycle and a dependency on an absent node."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    tree = p.where(F.col("node") >= 2).select(F.col("node").alias("src"),
                                              F.floor(F.col("node") / 2).alias("dst"))
    extra_nodes = spark.createDataFrame([(900001,), (900002,)], "node long")
    extra = spark.createDataFrame([(900001, 900002), (900002, 900001), (3, 999999999)],
                                  "src long, dst long")
    return p.unionByName(extra_nodes), tree.unionByName(extra)


# ---------------------------------------------------------------------------
# FIXED VALUES: spec-form requests (YAML and JSON), from the audited system's tests
SPEC_TEXTS: list[str] = [
    "intent: pure_function\nverb: add\nnoun: Total\nlanguage: javascript",
    '{"intent": "predicate", "verb": "validate", "noun": "EvenNumber", "language": "javascript"}',
    "intent: aggregator\nverb: sum\nnoun: Orders\nlanguage: python",
    "intent: pure_function\nnoun: Total\nlanguage: javascript",
    "verb: add\nnoun: Total\nlanguage: javascript",
    "intent: unknown_type\nverb: add\nnoun: Total\nlanguage: javascript",
    "intent: pure_function\nverb: add\nnoun: Total\nlanguage: rust",
    "- just\n- a list",
    '{"intent": "DATA_CONTRACT", "verb": "define", "noun": "User", "language": " Go "}',
    '{"verb": "add", "noun": "Total", "language": "go"}',
    '["intent", "verb"]',
    '{"intent": "side_effect_op", "verb": "save", "noun": "User", "language": "java"}',
    '{"intent": "predicate", "verb": "check", "verb": "validate", "noun": "Age", "language": "go"}',
    "intent: pure_function\nverb: 2024-99-99\nnoun: Total\nlanguage: javascript",
    "intent: ~\nverb: add\nnoun: Total\nlanguage: javascript",
    '{"intent": "predicate", "verb": null, "noun": "Age", "language": "go"}',
    "intent: predicate\nverb: check\nnoun: [Age]\nlanguage: go",
    "intent: predicate\nverb: check\nnoun: Age\nlanguage: ",
    '{"intent": 5, "verb": "check", "noun": "Age", "language": "go"}',
]
# ---------------------------------------------------------------------------


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spec_text(spec_id, body): one spec-form request per order."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("spec_id"), pick(SPEC_TEXTS, k % len(SPEC_TEXTS)).alias("body"))
