"""Column expressions shared by the operators.

All of these are built-in Spark expressions (whole-stage codegen), except
``nfkc`` which needs Python's Unicode tables; it is an Arrow-batched pandas
UDF that receives NULL for every row that cannot change under NFKC, so the
Python worker only ever sees the rare rows that need it.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from canopy.functions import dims

WS = dims.PY_WHITESPACE


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# every code point Python's str.isspace() accepts (what str.strip() removes)
PY_SPACE_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def py_strip(c: str | Column) -> Column:
    """Python ``str.strip()``: removes Unicode whitespace at both ends (no regex)."""
    return F.btrim(col(c), F.lit(PY_SPACE_CHARS))


def py_split_words(c: str | Column) -> Column:
    """Python ``str.split()`` (whitespace runs, no empty parts) as an array."""
    return F.filter(F.split(py_strip(c), f"{WS}+"), lambda w: w != "")


# a string made only of these code points is unchanged by NFKC
# (ASCII, C1 controls, Latin-1 letters); anything else goes through Python
_NFKC_STABLE = "^[\\x{0}-\\x{9f}\\x{c0}-\\x{ff}]*\\z"


@F.pandas_udf(StringType())
def _nfkc_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(c: str | Column) -> Column:
    c = col(c)
    return F.coalesce(_nfkc_udf(F.when(~c.rlike(_NFKC_STABLE), c)), c)


def any_contains(c: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(n) for n in needles])


def has_word(lowered: Column, words: list[str]) -> Column:
    """True when one of ``words`` is a whitespace-delimited token of the text."""
    alts = "|".join(re.escape(w) for w in words)
    # a text without any of the words needs no regular expression
    return any_contains(lowered, words) & lowered.rlike(f"(?:^|{WS})(?:{alts})(?:{WS}|\\z)")


def canonical_verb(lowered: Column, table=dims.VERB_SYNONYMS) -> Column:
    """First verb (in table order) having any synonym as a substring."""
    expr = None
    for verb, syns in table:
        cond = any_contains(lowered, syns)
        expr = F.when(cond, verb) if expr is None else expr.when(cond, verb)
    return expr.otherwise("unknown")


def _noun_regex(excluded: list[str]) -> str:
    # first maximal [a-z] run of length >= 3 that is not an excluded word
    alts = "|".join(sorted({w for w in excluded if re.fullmatch("[a-z]+", w)},
                           key=lambda w: (-len(w), w)))
    return f"(?<![a-z])(?!(?:{alts})(?![a-z]))[a-z]{{3,}}"


def canonical_noun(lowered: Column, verb: Column, table=dims.VERB_SYNONYMS,
                   default_nouns=dims.DEFAULT_NOUNS) -> Column:
    """First token of ``[a-z]+`` longer than 2 that is no filler and no synonym of
    the verb, capitalised; else the verb's default noun; else ``Unknown``."""
    token = F.when(verb == "unknown",
                   F.regexp_extract(lowered, _noun_regex(dims.FILLER_WORDS), 0))
    for v, syns in table:
        token = token.when(verb == v, F.regexp_extract(
            lowered, _noun_regex(dims.FILLER_WORDS + syns), 0))
    default = F.when(verb == "unknown", F.lit("Unknown"))
    for v, _ in table:
        default = default.when(verb == v, F.lit(default_nouns.get(v, "Unknown")))
    default = default.otherwise(F.lit("Unknown"))
    return F.when(token != "", F.concat(F.upper(F.substring(token, 1, 1)),
                                        F.substring(token, 2, 1 << 30))).otherwise(default)


def classifier_matches(raw_lower: Column, verb: Column) -> Column:
    """Array of matching canonical types, in rule priority order."""
    d = dims
    is_in = lambda vals: verb.isin(vals)
    coll = has_word(raw_lower, d.COLLECTION_NOUNS)
    rules = [
        ("PURE_FUNCTION", is_in([v for v in d.PURE_VERBS if v not in d.IO_VERBS])),
        ("PREDICATE", has_word(raw_lower, d.PREDICATE_KEYWORDS) | (verb == "validate")),
        ("TRANSFORMER", verb == "transform"),
        ("AGGREGATOR", (coll & has_word(raw_lower, d.AGGREGATOR_KEYWORDS))
         | (is_in(["add", "calculate"]) & coll)),
        ("SIDE_EFFECT_OP", is_in(d.SIDE_EFFECT_VERBS)),
        ("CLASS_METHOD", any_contains(raw_lower, d.CLASS_KEYWORDS)),
        ("ASYNC_OPERATION", (verb == "fetch") | has_word(raw_lower, d.ASYNC_KEYWORDS)),
        ("DATA_CONTRACT", (verb == "define")
         | (has_word(raw_lower, d.DATA_CONTRACT_KEYWORDS)
            & ~is_in(d.PURE_VERBS + d.SIDE_EFFECT_VERBS + ["fetch", "validate", "transform"]))),
    ]
    return F.filter(F.array(*[F.when(cond, F.lit(t)) for t, cond in rules]),
                    lambda x: x.isNotNull())


def snake_case(c: Column) -> Column:
    s = F.lower(F.regexp_replace(c, "([A-Z])", "_$1"))
    s = F.regexp_replace(s, "^_+", "")
    return F.regexp_replace(s, "__+", "_")


def function_name(intent_type: Column, verb: Column, noun: Column, language: Column) -> Column:
    """Identifier the prompt asks for, per naming rule and language casing."""
    has_noun = F.coalesce(noun, F.lit("")) != ""
    base = (
        F.when(intent_type == "PURE_FUNCTION",
               F.when(has_noun, F.concat(F.lower(F.substring(noun, 1, 1)),
                                         F.substring(noun, 2, 1 << 30))).otherwise("result"))
        .when(intent_type == "PREDICATE", F.concat(F.lit("is"), noun))
        .when(intent_type == "TRANSFORMER", F.concat(F.lit("to"), noun))
        .when(intent_type == "AGGREGATOR", F.concat(F.lit("reduce"), noun))
        .otherwise(F.concat(verb, noun))
    )
    cased = F.when(language == "python", snake_case(base)).otherwise(base)
    return F.when(intent_type == "DATA_CONTRACT",
                  F.when(has_noun, noun).otherwise("Unknown")).otherwise(cased)


def intent_key(verb: Column, noun: Column, language: Column, intent_type: Column) -> Column:
    return F.md5(F.concat_ws(":", verb, noun, language, intent_type))


def hash16(c: Column) -> Column:
    """First 16 hex digits of SHA-256 over the UTF-8 text."""
    return F.substring(F.sha2(c, 256), 1, 16)


def fill(template: str, **values: F.Column) -> F.Column:
    """A fixed text with its {names} replaced by columns (NULL if one of them is)."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])
