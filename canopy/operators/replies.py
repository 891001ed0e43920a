"""Reply-side operators (#20-#26): sections, validation, hashing, audits.

A reply is one row; all section work happens inside the row with
higher-order array functions (no shuffle).  Only the reports aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.functions import dims
from canopy.functions import text as T
from canopy.functions.frames import settle

SECTION_RE = "(?sU)---(\\w+)---(.*?)(?=---|\\z)"
FENCE_RE = "(?U)```\\w*\\n?"
IMPORT_RES = [
    "(?mdU)^\\s*import\\s+",
    "(?mdU)^\\s*from\\s+\\S+\\s+import\\s+",
    "(?mdU)^\\s*require\\s*\\(",
]


def with_sections(attempts: DataFrame) -> DataFrame:
    """Add ``_names`` / ``_bodies``: every ``---NAME---`` block and its raw body.

    Each regex runs once per reply.  A repeated name keeps its last block:
    ``section_body`` looks names up from the end, so no lambda is needed and
    the whole job stays in generated code.
    """
    return (attempts
            .withColumn("_names", F.regexp_extract_all(F.col("raw"), F.lit(SECTION_RE), 1))
            .withColumn("_bodies", F.regexp_extract_all(F.col("raw"), F.lit(SECTION_RE), 2)))


def section_body(name: str) -> F.Column:
    """Trimmed body of the last block called ``name`` (NULL when absent)."""
    back = F.array_position(F.reverse(F.col("_names")), F.lit(name))
    return F.when(back > 0, T.py_strip(F.element_at(F.col("_bodies"), -back.cast("int"))))


# ---------------------------------------------------------------- #20 ----
def extract_sections(attempts: DataFrame) -> DataFrame:
    """Long form: (req_id, attempt, pos, section, body); last block of a name wins."""
    s = with_sections(attempts).select(
        "req_id", "attempt", "_names",
        F.posexplode(F.arrays_zip(F.col("_names"), F.col("_bodies"))).alias("pos", "z"))
    last = F.size("_names") - F.array_position(F.reverse(F.col("_names")), F.col("z._names"))
    return s.where(F.col("pos") == last).select(
        "req_id", "attempt", F.col("pos").cast("int").alias("pos"),
        F.col("z._names").alias("section"), T.py_strip(F.col("z._bodies")).alias("body"))


# ---------------------------------------------------------------- #21 ----
def count_of(c: F.Column, needle: str) -> F.Column:
    """Non-overlapping occurrences of ``needle`` (Python ``str.count``)."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def validate_replies(attempts: DataFrame) -> DataFrame:
    """Add ``status``, ``detail``, ``code`` and ``content_hash`` to every reply.

    Checks in order: ambiguity, no_sections, missing_section (first missing in
    required order), fence_missing / fence_multiple, empty_code, import, ok.
    """
    s = with_sections(attempts)
    impl = section_body("IMPLEMENTATION")
    code = T.py_strip(F.regexp_replace(F.col("_impl"), FENCE_RE, ""))
    missing = F.array_except(F.array(*[F.lit(n) for n in dims.REQUIRED_SECTIONS]),
                             F.col("_names"))
    has_import = None
    for r in IMPORT_RES:
        c = F.col("code").rlike(r)
        has_import = c if has_import is None else has_import | c
    status = (F.when(F.col("raw").contains("---AMBIGUITY---"), "ambiguity")
              .when(F.size("_names") == 0, "no_sections")
              .when(F.size("_missing") > 0, "missing_section")
              .when(F.col("_fences") < 2, "fence_missing")
              .when(F.col("_fences") > 2, "fence_multiple")
              .when(F.col("code") == "", "empty_code")
              .when(has_import, "import")
              .otherwise("ok"))
    return (s.withColumn("_missing", missing)
            .withColumn("_impl", impl)
            .withColumn("_fences", count_of(F.col("_impl"), "```"))
            .withColumn("code", F.when(F.col("_fences") == 2, code))
            .withColumn("status", status)
            .withColumn("detail", F.when(F.col("status") == "missing_section",
                                         F.element_at("_missing", 1)))
            .withColumn("content_hash", F.when(F.col("status") == "ok", T.hash16(F.col("code")))
                        .when(F.col("status") == "ambiguity", F.lit("")))
            .drop("_missing", "_fences", "_impl")
            .transform(lambda d: settle(d, ["_names", "_bodies", "code", "status", "detail",
                                            "content_hash"])))


def failure_rates(validated: DataFrame, by: str = "language") -> DataFrame:
    return validated.groupBy("status", by).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- #22 ----
SECTION_COLUMNS = [(n, n.lower()) for n in dims.REQUIRED_SECTIONS + dims.OPTIONAL_SECTIONS]


def pivot_sections(validated: DataFrame) -> DataFrame:
    """One row per valid reply with the six sections as columns.

    The pivot happens inside the row (map lookup), so no shuffle is needed;
    ``implementation`` is the code with fences stripped.
    """
    return validated.where(F.col("status") == "ok").select(
        "req_id", "attempt", *[c for c in ("session_id", "ts") if c in validated.columns],
        "content_hash", *section_columns())


def section_columns() -> list[F.Column]:
    """The six section columns of a validated reply (code with fences stripped)."""
    return [F.col("code").alias("implementation") if n == "IMPLEMENTATION"
            else section_body(n).alias(c) for n, c in SECTION_COLUMNS]


def with_section_columns(validated: DataFrame) -> DataFrame:
    """All replies with the six section columns, NULL unless the reply is valid."""
    ok = F.col("status") == "ok"
    cols = [F.when(ok, F.col("code")).alias("implementation") if n == "IMPLEMENTATION"
            else F.when(ok, section_body(n)).alias(c) for n, c in SECTION_COLUMNS]
    return validated.select("*", *cols)


# ---------------------------------------------------------------- #23 ----
def hash_groups(sections: DataFrame) -> DataFrame:
    """Groups of replies with identical implementation hash."""
    return (sections.groupBy("content_hash")
            .agg(F.count("*").alias("n_replies"), F.count_distinct("req_id").alias("n_requests"),
                 F.min("req_id").alias("first_req_id")))


# ---------------------------------------------------------------- #24 ----
_DECLARED = {"declared_type": "type", "declared_confidence": "confidence",
             "declared_verb": "canonical_verb", "declared_noun": "canonical_noun"}


def declared_classification(sections: DataFrame) -> DataFrame:
    """What each reply declares about its request; null where it has no such line.  A reply
    that declares MEDIUM or LOW should have had an ambiguity block instead: ``unflagged``."""
    ic = F.col("intent_classification")

    def field(name):
        v = F.regexp_extract(ic, f"(?mdU)^\\s*{name}\\s*:\\s*(\\S+)", 1)
        return F.when(v != "", v)
    d = sections.select("req_id", "attempt", *[field(n).alias(c) for c, n in _DECLARED.items()])
    return d.withColumn("unflagged", F.coalesce(
        F.col("declared_confidence").isin("MEDIUM", "LOW"), F.lit(False)))


def declared_vs_inferred(sections: DataFrame, classified: DataFrame) -> DataFrame:
    """Confusion counts of what replies declare against our classification."""
    d = declared_classification(sections)
    c = classified.select("req_id", F.col("intent_type").alias("inferred_type"),
                          F.col("confidence").alias("inferred_confidence"), "verb", "noun")

    def differs(declared, inferred):
        return F.sum(F.when(F.col(declared) != F.col(inferred), 1).otherwise(0))

    return (d.join(c, "req_id")
            .groupBy("declared_type", "inferred_type", "declared_confidence",
                     "inferred_confidence")
            .agg(F.count("*").alias("n"),
                 differs("declared_type", "inferred_type").alias("n_type_mismatch"),
                 differs("declared_verb", "verb").alias("n_verb_mismatch"),
                 differs("declared_noun", "noun").alias("n_noun_mismatch"),
                 F.sum(F.col("unflagged").cast("int")).alias("n_unflagged")))


# ---------------------------------------------------------------- #25 ----
# audit rules: (name, section column, Spark condition true on a violation)
def _audit_rules():
    inv, orc = F.col("invariants"), F.col("test_oracle")
    return [
        ("missing_preconditions", ~inv.rlike("(?i)preconditions")),
        ("missing_postconditions", ~inv.rlike("(?i)postconditions")),
        ("missing_edge_cases", ~inv.rlike("(?i)edge[_ ]cases")),
        ("no_numeric_edge_case", ~inv.rlike("[0-9]")),
        ("see_implementation", inv.rlike("(?i)see implementation")),
        ("few_asserts", count_of(orc, "assert") < 3),
        ("test_wrapper", orc.rlike("(?:^|[^A-Za-z0-9_])(?:describe|it|test)\\s*\\(")),
        ("mock_stub_spy", orc.rlike("(?i)(?:mock|stub|spy|spies)")),
    ]


def audit_sections(sections: DataFrame) -> DataFrame:
    """violations(req_id, attempt, rule): one row per broken invariant / oracle rule."""
    arr = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in _audit_rules()]),
                   lambda x: x.isNotNull())
    return sections.select("req_id", "attempt", F.explode(arr).alias("rule"))


def audit_rates(sections: DataFrame) -> DataFrame:
    v = audit_sections(sections)
    return v.groupBy("rule").agg(F.count("*").alias("n_violations"))


def audit_rates_by_type(sections: DataFrame) -> DataFrame:
    """Broken and checked replies of each rule and declared type, with the rate; a rule
    that never fires has a row too.  One pass: rules are exploded with their outcome."""
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(False)).alias("bad"))
                      for n, c in _audit_rules()])
    declared = F.regexp_extract(F.col("intent_classification"),
                                "(?mdU)^\\s*type\\s*:\\s*(\\S+)", 1)
    return (sections.select(F.when(declared != "", declared).alias("declared_type"),
                            F.inline(rules))
            .groupBy("rule", "declared_type").agg(
                F.count("*").alias("n_replies"), F.sum(F.col("bad").cast("int")).alias("n_violations"))
            .withColumn("rate", F.round(F.col("n_violations") / F.col("n_replies"), 6)))


# ---------------------------------------------------------------- #26 ----
def _balanced(depth: int) -> str:
    """Text in which parentheses match, up to ``depth`` levels deep."""
    inner = "[^()]*+"
    for _ in range(depth):
        inner = f"[^()]*+(?:\\({inner}\\)[^()]*+)*+"
    return inner


_LIST = f"\\(({_balanced(4)})\\)"
# where a parameter list belongs to a definition; each pattern has the list as its group 1
DEFINITIONS = [
    f"\\bfunction\\b\\s*\\*?\\s*[\\w$]*\\s*{_LIST}",
    f"\\bdef\\s+\\w+\\s*{_LIST}",
    f"\\bfunc\\b\\s*(?:\\([^()]*\\)\\s*)?\\w*\\s*{_LIST}",
    f"{_LIST}\\s*(?::[^=(){{}}\\n]+)?=>",  # arrow functions
    "(?<![\\w$.])([A-Za-z_$][\\w$]*)\\s*=>",
    "\\blambda\\b([^:\\n]*):",
    # methods of a class or object: a name, a list, a body
    "(?m)^[ \\t]*(?:(?:public|private|protected|static|async|get|set)\\s+)*"
    "(?!(?:if|for|while|switch|catch|return|function|with)\\b)[A-Za-z_$][\\w$]*\\s*"
    f"{_LIST}\\s*(?::[^{{}}\\n]+)?\\{{",
]
# what stands in a list but names no parameter, innermost first: strings, nested calls and
# generics, type literals, and default values
_NOT_NAMES = ["'[^'\\n]*'|\"[^\"\\n]*\"", *["\\([^()]*\\)"] * 4, *["<[^<>]*>"] * 2,
              "[:=]\\s*\\{[^{}]*\\}", "=\\s*\\[[^\\[\\]]*\\]"]


def parameter_names(c: F.Column) -> F.Column:
    """Names of the parameters of all function definitions in the text, destructured ones
    (``{a, b}``) and lambdas' included.  Arguments of calls are no parameters, nor are names
    inside default values."""
    lists = F.concat(*[F.regexp_extract_all(c, F.lit(d), F.lit(1)) for d in DEFINITIONS])

    def cleaned(x):
        for pattern in _NOT_NAMES:
            x = F.regexp_replace(x, pattern, " ")
        return F.regexp_replace(x, "=[^,]*", " ")

    params = F.flatten(F.transform(lists, lambda x: F.split(
        F.translate(cleaned(x), "{}[]", "    "), ",")))
    names = F.transform(params, lambda p: F.regexp_extract(
        p, "^\\s*(?:\\.{3}|\\*{1,2})?([A-Za-z_$][\\w$]*)", 1))
    return F.filter(names, lambda n: n != "")


def naming_audit(sections: DataFrame, banned: list[str] = dims.BANNED_PARAMETER_NAMES) -> DataFrame:
    """findings(req_id, attempt, place, param): banned parameter names of the definitions in
    the signature and the implementation, one row per parameter."""
    places = F.explode(F.array(*[
        F.struct(F.lit(c).alias("place"), F.col(c).alias("body"))
        for c in ("signature", "implementation")]))
    return (sections.select("req_id", "attempt", places.alias("p"))
            .select("req_id", "attempt", "p.place",
                    F.explode(parameter_names(F.col("p.body"))).alias("param"))
            .where(F.col("param").isin(banned)))
