"""Dimension values of the audit rules.

Everything in the FIXED VALUES block must equal the rule tables the audited
system uses; order matters where noted (first match wins).  The rest of the
library reads these lists only through small helper functions so that a new
table version (see ``taxonomy_diff``) can be passed in as a parameter.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the audited system exactly; keep in this order)
# ---------------------------------------------------------------------------

# canonical verb -> synonyms; verbs are tried in this order, first hit wins
VERB_SYNONYMS: list[tuple[str, list[str]]] = [
    ("add", ["add", "sum", "plus", "combine"]),
    ("subtract", ["subtract", "minus", "remove from"]),
    ("multiply", ["multiply", "times", "product"]),
    ("divide", ["divide", "split by", "quotient"]),
    ("format", ["format", "render", "display", "show"]),
    ("fetch", ["fetch", "get", "retrieve", "pull"]),
    ("validate", ["validate", "check", "verify", "ensure"]),
    ("transform", ["transform", "convert", "map", "cast"]),
    ("calculate", ["calculate", "compute", "derive"]),
    ("save", ["save", "persist", "store", "write"]),
    ("define", ["define", "model", "schema", "shape", "contract"]),
]

# canonical verb -> noun used when the text names none
DEFAULT_NOUNS: dict[str, str] = {
    "add": "Total",
    "subtract": "Difference",
    "multiply": "Product",
    "divide": "Quotient",
    "format": "Output",
    "fetch": "Data",
    "validate": "Input",
    "transform": "Output",
    "calculate": "Result",
    "save": "Record",
    "define": "Entity",
}

# words never taken as the noun
FILLER_WORDS: list[str] = [
    "write", "create", "make", "build", "a", "an", "the", "function",
    "method", "that", "to", "two", "numbers", "me", "i", "need",
    "type", "interface", "struct", "class", "for", "with", "new",
]

# a request containing one of these (lowered) is a spec, not free text
SPEC_MARKERS: list[str] = ["intent:", "verb:", "noun:", "---"]

# language alias -> language
LANGUAGE_ALIASES: list[tuple[str, str]] = [
    ("js", "javascript"),
    ("javascript", "javascript"),
    ("ts", "typescript"),
    ("typescript", "typescript"),
    ("py", "python"),
    ("python", "python"),
    ("python3", "python"),
    ("go", "go"),
    ("golang", "go"),
]
LANGUAGES: list[str] = ["javascript", "typescript", "python", "go"]

# canonical types in priority order (rule order of the classifier)
TYPES: list[str] = [
    "PURE_FUNCTION", "PREDICATE", "TRANSFORMER", "AGGREGATOR",
    "SIDE_EFFECT_OP", "CLASS_METHOD", "ASYNC_OPERATION", "DATA_CONTRACT",
]

# classifier keyword sets
IO_VERBS: list[str] = ["save", "delete", "send", "fetch", "stream", "write", "update"]
PREDICATE_KEYWORDS: list[str] = ["is", "has", "can", "should"]
AGGREGATOR_KEYWORDS: list[str] = ["reduce", "sum", "count", "group", "filter", "aggregate"]
CLASS_KEYWORDS: list[str] = ["method", "on class", "inside", "member of", "member"]
ASYNC_KEYWORDS: list[str] = ["async", "await", "concurrent", "stream", "poll"]
DATA_CONTRACT_KEYWORDS: list[str] = [
    "type", "interface", "struct", "schema", "model",
    "entity", "record", "dto", "contract", "shape",
]
COLLECTION_NOUNS: list[str] = [
    "users", "items", "orders", "records", "entries", "elements",
    "events", "messages", "results", "values", "rows", "documents",
]
PURE_VERBS: list[str] = ["add", "subtract", "multiply", "divide", "calculate", "format"]
SIDE_EFFECT_VERBS: list[str] = ["save", "delete", "send", "update", "write"]

# naming rule per canonical type
NAME_RULES: dict[str, str] = {
    "PURE_FUNCTION": "noun_only",
    "PREDICATE": "is_prefix",
    "TRANSFORMER": "to_prefix",
    "AGGREGATOR": "reduce_prefix",
    "SIDE_EFFECT_OP": "verb_noun",
    "CLASS_METHOD": "verb_noun",
    "ASYNC_OPERATION": "verb_noun",
    "DATA_CONTRACT": "pascal_noun",
}

# multi-intent splitter
SINGLE_INTENT_PHRASES: list[str] = [
    "calculator", "crud", "api", "module", "class",
    "service", "handler", "controller", "manager",
]
EXTRA_INTENT_VERBS: list[str] = ["write", "create", "make", "build", "implement"]

# gate texts by confidence; {names} stand for the row's values
LOW_QUESTION = (
    "What type of function is this? "
    "(pure_function / predicate / transformer / aggregator / "
    "side_effect_op / class_method / async_operation)"
)
GATE_TEXTS: dict[str, dict[str, str]] = {
    "MEDIUM": {
        "unclear_dimension":
            "Multiple intent types match for verb '{verb}': could be {type} or another type",
        "clarifying_question": "Is '{text}' intended as a {type}? (yes/no)",
        "assumed_interpretation": "Assuming {type} based on highest priority match",
    },
    "LOW": {
        "unclear_dimension": "Unrecognised verb or no matching intent type for: '{text}'",
        "clarifying_question": LOW_QUESTION,
        "assumed_interpretation": "Assuming PURE_FUNCTION as default for '{text}'",
    },
}

# user messages
CONTRACT_MESSAGE = (
    "Language target: {language}\nIntent type: {type}\nCanonical noun: {noun}\n"
    "Type name: {name}\n"
    "Generate the data contract following the exact template for DATA_CONTRACT.\n"
    "Define all fields with explicit types. Make the type immutable by default."
)
FUNCTION_MESSAGE = (
    "Language target: {language}\nIntent type: {type}\nCanonical verb: {verb}\n"
    "Canonical noun: {noun}\nFunction name: {name}\n"
    "Generate the function following the exact template for {type}."
)

# errors of project specifications
PROJECT_ERRORS: dict[str, str] = {
    "not_a_mapping": "Spec must be a YAML mapping",
    "no_project": "Missing top-level 'project' key",
    "project_kind": "'project' must be a mapping",
    "missing_field": "Missing required field '{key}' in {place}",
    "empty_field": "'{key}' must be a non-empty string in {place}",
    "language": "Unsupported language: '{language}'. Supported: {supported}",
    "contracts_kind": "'data_contracts' must be a list",
    "modules_kind": "'modules' must be a list",
    "entry_kind": "{place} must be a mapping",
    "function_kind": "{place} must be a string or mapping",
    "repeated_contract": "Duplicate data contract name: '{name}'",
    "repeated_module": "Duplicate module name: '{name}'",
    "no_fields": "{place} '{name}' must have non-empty 'fields' mapping",
    "no_functions": "{place} '{name}' must have non-empty 'functions' list",
    "empty_project": "Project must have at least one module or data_contract",
}

# reply sections, in required order; DEPENDENCIES is optional
REQUIRED_SECTIONS: list[str] = [
    "INTENT_CLASSIFICATION", "SIGNATURE", "IMPLEMENTATION", "INVARIANTS", "TEST_ORACLE",
]
OPTIONAL_SECTIONS: list[str] = ["DEPENDENCIES"]

RETRY_SUFFIX = (
    "\n\nYour previous response did not conform to the required output schema. "
    "Reformat strictly. Every required section (INTENT_CLASSIFICATION, SIGNATURE, "
    "IMPLEMENTATION, INVARIANTS, TEST_ORACLE) must be present, delimited by ---, "
    "with no prose before or after. No alternatives. No explanations."
)
MAX_RETRIES = 3

# pinned call configuration
PINNED_MODEL = "claude-sonnet-4-20250514"
PINNED_TEMPERATURE = 0
PINNED_MAX_TOKENS = 2048
CONTEXT_ALERT_SHARE = 0.40

# parameter names a signature must not use
BANNED_PARAMETER_NAMES: list[str] = [
    "a", "b", "x", "y", "n1", "n2", "num1", "num2", "uid", "list", "arr", "data", "items",
]

# traced stage names
SPAN_OPERATIONS: list[str] = [
    "normalize", "spec_validate", "classify", "ambiguity_gate", "bind_template",
    "execute_with_retry",
]

# spec-row intent names (lower case) -> canonical type
SPEC_INTENTS: dict[str, str] = {t.lower(): t for t in TYPES}
SPEC_REQUIRED_FIELDS: list[str] = ["intent", "verb", "noun", "language"]

# project specs accept these language spellings, unresolved
PROJECT_LANGUAGES: list[str] = [
    "javascript", "typescript", "python", "go", "js", "ts", "py", "golang",
]

# Python's str.isspace() set, written as a regex class usable by Java and RE2
PY_WHITESPACE = (
    "[\\t\\n\\x0b\\x0c\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
    "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
)

# ---------------------------------------------------------------------------
# end of fixed values
# ---------------------------------------------------------------------------


def all_synonyms(table: list[tuple[str, list[str]]] = VERB_SYNONYMS) -> list[str]:
    seen: list[str] = []
    for _, syns in table:
        for s in syns:
            if s not in seen:
                seen.append(s)
    return seen
