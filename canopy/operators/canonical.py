"""Canonicalise, classify, gate and the request-side reports (#9-#19).

Every operator is a column-expression job (narrow, codegen'd) or a single
aggregation with map-side partial aggregation, so hot keys (a handful of
intent keys hold most rows) never concentrate in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions import dims
from canopy.functions import text as T
from canopy.functions.frames import settle
from canopy.sources.specs import ingest_specs
from canopy.sources.ingest import ingest_requests, split_ingested


# ---------------------------------------------------------------- #10 ----
def canonicalise(requests: DataFrame, table=dims.VERB_SYNONYMS) -> DataFrame:
    """Add ``verb`` and ``noun`` from the normalised text (``norm_text``)."""
    lowered = F.lower(F.col("norm_text"))
    return (settle(requests.withColumn("_lowered", lowered), ["_lowered"])
            .withColumn("verb", T.canonical_verb(F.col("_lowered"), table))
            .transform(lambda d: settle(d, ["verb"]))
            .withColumn("noun", T.canonical_noun(F.col("_lowered"), F.col("verb"), table))
            .drop("_lowered"))


# ---------------------------------------------------------------- #11 ----
def classify(canonical: DataFrame) -> DataFrame:
    """Rule classification on the raw (not normalised) lowered text."""
    n = F.size("matches")
    # the lowered text and the verb are read by many conditions: computed once per row
    raw = settle(canonical.withColumn("_raw_l", F.lower("text")), ["_raw_l", "verb"])
    m = T.classifier_matches(F.col("_raw_l"), F.col("verb"))
    return (settle(raw.withColumn("matches", m), ["matches"])
            .withColumn("intent_type", F.coalesce(F.try_element_at("matches", F.lit(1)),
                                                  F.lit("PURE_FUNCTION")))
            .withColumn("confidence", F.when(n == 1, "HIGH").when(n >= 2, "MEDIUM")
                        .otherwise("LOW"))
            .withColumn("intent_key", T.intent_key(F.col("verb"), F.col("noun"),
                                                   F.col("language"), F.col("intent_type")))
            .drop("_raw_l")
            .transform(lambda d: settle(d, ["verb", "noun", "matches", "intent_type",
                                            "confidence", "intent_key"])))


def classify_requests(raw: DataFrame, table=dims.VERB_SYNONYMS) -> DataFrame:
    """#1 -> #10 -> #11 for free-text rows (spec rows go to ``ingest_specs``)."""
    ok, _ = split_ingested(ingest_requests(raw))
    return classify(canonicalise(ok.where(F.col("source") == "freetext"), table))


def classify_all(raw: DataFrame) -> DataFrame:
    """Every request with its classification or the reason it has none: both branches.

    Free text is normalised and classified; spec rows bypass that and are validated, with
    HIGH confidence.  ``error`` is the ingest rejection (``rejected``) or the spec's error;
    the columns of ``classify`` are null then.  Spec rows take verb, noun and language from the spec."""
    ing = ingest_requests(raw)
    kept = ["req_id", "session_id", "ts", "text", "source"]
    accepted = ing.where(F.col("status") == "ok")
    free = classify(canonicalise(accepted.where(F.col("source") == "freetext"))).select(
        *kept, "language", "verb", "noun", "intent_type", "confidence", "intent_key",
        F.lit(None).cast("string").alias("error"), F.lit(False).alias("rejected"))
    spec_rows = accepted.where(F.col("source") != "freetext").select(
        F.to_json(F.struct(*kept[:-1]), {"ignoreNullFields": "false"}).alias("spec_id"),
        F.col("text").alias("body"))
    shape = accepted.select(*kept[:-1]).schema
    specs = ingest_specs(spec_rows).select(
        F.from_json("spec_id", shape).alias("row"), "source", "language", "verb", "noun",
        "intent_type", "confidence", "error").select(
        "row.*", "source", "language", "verb", "noun", "intent_type", "confidence",
        F.when(F.col("error").isNull(), T.intent_key(
            F.col("verb"), F.col("noun"), F.col("language"), F.col("intent_type")))
        .alias("intent_key"), "error", F.lit(False).alias("rejected"))
    nothing = [F.lit(None).cast("string").alias(c) for c in (
        "language", "verb", "noun", "intent_type", "confidence", "intent_key")]
    rejected = ing.where(F.col("status") != "ok").select(
        *kept, *nothing, F.col("status").alias("error"), F.lit(True).alias("rejected"))
    return free.unionByName(specs).unionByName(rejected)


# ---------------------------------------------------------------- #12 ----
def gate(classified: DataFrame) -> DataFrame:
    """Add ``route`` (passed / quarantine) and the three quarantine texts."""
    values = {"type": F.col("intent_type"), "verb": F.col("verb"), "text": F.col("text")}
    high, medium = F.col("confidence") == "HIGH", F.col("confidence") == "MEDIUM"
    out = classified.withColumn("route", F.when(high, "passed").otherwise("quarantine"))
    for column, low_text in dims.GATE_TEXTS["LOW"].items():
        out = out.withColumn(column, F.when(~high, F.when(
            medium, T.fill(dims.GATE_TEXTS["MEDIUM"][column], **values))
            .otherwise(T.fill(low_text, **values))))
    return out


def split_gate(gated: DataFrame) -> tuple[DataFrame, DataFrame]:
    p = F.col("route") == "passed"
    return gated.where(p), gated.where(~p)


def quarantine_rate(gated: DataFrame) -> DataFrame:
    return (gated.groupBy("confidence", "language")
            .agg(F.count("*").alias("n"),
                 F.sum(F.when(F.col("route") == "quarantine", 1).otherwise(0)).alias("quarantined")))


# ---------------------------------------------------------------- #13 ----
def collapse_phrasings(passed: DataFrame) -> DataFrame:
    """One row per intent key: phrasings, distinct texts, earliest text, prompts."""
    named = passed.withColumn("function_name", T.function_name(
        F.col("intent_type"), F.col("verb"), F.col("noun"), F.col("language")))
    return (named.groupBy("intent_key", "verb", "noun", "language", "intent_type")
            .agg(F.count("*").alias("phrasings"),
                 F.count_distinct("text").alias("distinct_texts"),
                 F.min_by("text", F.struct("ts", "req_id")).alias("representative"),
                 F.count_distinct("function_name").alias("prompts")))


# ---------------------------------------------------------------- #14 ----
def user_message(intent_type, verb, noun, language, name) -> F.Column:
    values = {"type": intent_type, "verb": verb, "noun": noun, "language": language, "name": name}
    return F.when(intent_type == "DATA_CONTRACT", T.fill(dims.CONTRACT_MESSAGE, **values)) \
        .otherwise(T.fill(dims.FUNCTION_MESSAGE, **values))


def bind_prompts(passed: DataFrame) -> DataFrame:
    """Every passed request with its function name, user message and prompt id."""
    name = T.function_name(F.col("intent_type"), F.col("verb"), F.col("noun"), F.col("language"))
    return (passed.withColumn("function_name", name)
            .withColumn("user_message", user_message(F.col("intent_type"), F.col("verb"),
                                                     F.col("noun"), F.col("language"),
                                                     F.col("function_name")))
            .withColumn("prompt_id", T.hash16(F.col("user_message"))))


def system_prompts(spark: SparkSession, texts: list[str]) -> DataFrame:
    """system_prompts(system_prompt_hash, system_prompt): each text once, under its hash."""
    rows = spark.createDataFrame([(t,) for t in dict.fromkeys(texts)], "system_prompt string")
    return rows.select(T.hash16(F.col("system_prompt")).alias("system_prompt_hash"),
                       "system_prompt")


def bind_system_prompt(work: DataFrame, text: str) -> DataFrame:
    """Prompts with the hash of the system prompt that goes with all of them; the text itself
    is stored once (``system_prompts``), not on every row."""
    return work.withColumn("system_prompt_hash", T.hash16(F.lit(text)))


def build_prompt_work(passed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prompt_work: each distinct prompt once, fanout: req_id -> prompt_id)."""
    bound = bind_prompts(passed)
    work = (bound.groupBy("prompt_id", "intent_key", "language", "intent_type", "function_name",
                          "user_message")
            .agg(F.count("*").alias("n_requests")))
    fanout = bound.select("req_id", "prompt_id")
    return work, fanout


# ---------------------------------------------------------------- #15 ----
def name_collisions(passed: DataFrame) -> DataFrame:
    """Identifiers that different intent keys map to in one language."""
    named = (passed.select("language", "intent_key", T.function_name(
        F.col("intent_type"), F.col("verb"), F.col("noun"), F.col("language")
    ).alias("function_name")).distinct())
    return (named.groupBy("language", "function_name")
            .agg(F.count("*").alias("n_keys"),
                 F.array_join(F.sort_array(F.collect_list("intent_key")), ",").alias("intent_keys"))
            .where(F.col("n_keys") > 1))


# ---------------------------------------------------------------- #16 ----
def intent_rollup(classified: DataFrame) -> DataFrame:
    """Counts over every combination of language, type, verb and confidence."""
    return (classified.cube("language", "intent_type", "verb", "confidence")
            .agg(F.grouping_id().alias("gid"), F.count("*").alias("n")))


# ---------------------------------------------------------------- #17 ----
def rule_overlap(classified: DataFrame) -> DataFrame:
    """How often two rules fire on the same request (pairs within <= 8 matches)."""
    pairs = F.flatten(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("matches"), F.lit(1))),
        lambda i: F.transform(
            F.filter(F.sequence(i + 1, F.greatest(F.size("matches"), i + 1)),
                     lambda j: j <= F.size("matches")),
            lambda j: F.struct(F.element_at("matches", i).alias("rule_1"),
                               F.element_at("matches", j).alias("rule_2")))))
    return (classified.where(F.size("matches") >= 2)
            .select(F.explode(pairs).alias("p"))
            .groupBy("p.rule_1", "p.rule_2").agg(F.count("*").alias("n")))


# ---------------------------------------------------------------- #18 ----
def verb_gap_topk(canonical: DataFrame, k: int = 20) -> DataFrame:
    """Most frequent leading words of requests whose verb is unknown."""
    word = F.regexp_extract(F.lower(F.col("norm_text")), "[a-z]+", 0)
    counts = (canonical.where(F.col("verb") == "unknown").select(word.alias("word"))
              .where(F.col("word") != "")
              .groupBy("word").agg(F.count("*").alias("n")))
    return counts.orderBy(F.desc("n"), F.asc("word")).limit(k)


def verb_gap_by_group(canonical: DataFrame, group: str = "lang", k: int = 5) -> DataFrame:
    """Leading words of unknown-verb requests ranked per group (dense rank <= k).

    The window runs over the aggregated (group, word) counts, one row per word."""
    from pyspark.sql import Window
    word = F.regexp_extract(F.lower(F.col("norm_text")), "[a-z]+", 0)
    counts = (canonical.where(F.col("verb") == "unknown").select(group, word.alias("word"))
              .where(F.col("word") != "")
              .groupBy(group, "word").agg(F.count("*").alias("n")))
    w = Window.partitionBy(group).orderBy(F.desc("n"))
    return counts.withColumn("rank", F.dense_rank().over(w)).where(F.col("rank") <= k)


# ---------------------------------------------------------------- #19 ----
# second table version used by the taxonomy diff (adds three verbs at the end)
VERB_SYNONYMS_V2 = dims.VERB_SYNONYMS + [
    ("delete", ["delete", "erase"]),
    ("send", ["send", "emit"]),
    ("update", ["update", "modify"]),
]


def taxonomy_diff(raw: DataFrame, old=dims.VERB_SYNONYMS, new=VERB_SYNONYMS_V2) -> DataFrame:
    """Classify with two table versions in one pass; rows whose verb, noun,
    type or confidence changed.

    Both versions are columns of the same projection over one scan (no join,
    no second pass over the text); ``settle`` keeps the change filter from
    re-running the text expressions.
    """
    ok, _ = split_ingested(ingest_requests(raw))
    out = (ok.where(F.col("source") == "freetext")
           .withColumn("_l", F.lower("norm_text")).withColumn("_raw_l", F.lower("text"))
           .transform(lambda d: settle(d, ["_l", "_raw_l"])))
    derived = []
    for tag, tbl in (("old", old), ("new", new)):
        m = f"_{tag}_m"
        out = settle(out.withColumn(f"{tag}_verb", T.canonical_verb(F.col("_l"), tbl)),
                     [f"{tag}_verb"])
        out = (out.withColumn(f"{tag}_noun", T.canonical_noun(F.col("_l"), F.col(f"{tag}_verb"), tbl))
               .withColumn(m, T.classifier_matches(F.col("_raw_l"), F.col(f"{tag}_verb")))
               .transform(lambda d, m=m: settle(d, [m]))
               .withColumn(f"{tag}_type", F.coalesce(F.try_element_at(m, F.lit(1)),
                                                     F.lit("PURE_FUNCTION")))
               .withColumn(f"{tag}_confidence", F.when(F.size(m) == 1, "HIGH")
                           .when(F.size(m) >= 2, "MEDIUM").otherwise("LOW")))
        derived += [f"{tag}_verb", f"{tag}_noun", f"{tag}_type", f"{tag}_confidence"]
    out = settle(out.select("req_id", "language", *derived), derived)
    changed = reduce(lambda a, b: a | b, [F.col(f"old_{x}") != F.col(f"new_{x}")
                                          for x in ("verb", "noun", "type", "confidence")])
    return out.where(changed).select(
        "req_id", "language", "old_verb", "new_verb", "old_noun", "new_noun",
        "old_type", "new_type", "old_confidence", "new_confidence")


def taxonomy_transitions(changed: DataFrame) -> DataFrame:
    return (changed.groupBy("old_type", "new_type", "old_confidence", "new_confidence")
            .agg(F.count("*").alias("n")))


# ----------------------------------------------------------------- #9 ----
def split_requests(requests: DataFrame) -> DataFrame:
    """One row per sub-intent: (req_id, pos, text)."""
    # what many conditions read is computed once per row (see ``settle``)
    rows = settle(requests.select("req_id", T.py_strip(F.col("text")).alias("_text")), ["_text"])
    rows = settle(rows.withColumn("_lowered", F.lower("_text")), ["_lowered"])
    rows = settle(rows.withColumn("_padded", F.concat(F.lit(" "), F.col("_lowered"), F.lit(" "))),
                  ["_padded"])
    text, lowered, padded = F.col("_text"), F.col("_lowered"), F.col("_padded")
    syns = dims.all_synonyms() + [v for v in dims.EXTRA_INTENT_VERBS
                                  if v not in dims.all_synonyms()]
    verb_count = sum(F.when(padded.contains(f" {s} "), 1).otherwise(0) for s in syns)
    rows = settle(rows.withColumn("_multi", verb_count >= 2), ["_multi"])
    multi = F.col("_multi")

    def clean(arr):
        return F.filter(F.transform(arr, lambda p: T.py_strip(p)), lambda p: p != "")

    numbered = clean(F.regexp_extract_all(text, F.lit("(?dU)\\d+\\.\\s*(.+?)(?=\\d+\\.|$)"), 1))
    commas = clean(F.split(text, ","))
    ands = F.split(text, "(?iU)\\band\\b(?:\\s+also\\b)?", -1)
    parts = (F.when(T.any_contains(lowered, dims.SINGLE_INTENT_PHRASES), F.array(text))
             .when(F.size(F.regexp_extract_all(
                 text, F.lit("(?dU)\\d+\\.\\s*(.+?)(?=\\d+\\.|$)"), 1)) >= 2, numbered)
             .when(text.contains(",") & multi & (F.size(commas) >= 2), commas)
             .when((F.size(ands) >= 2) & multi & (F.size(clean(ands)) >= 2), clean(ands))
             .otherwise(F.array(text)))
    return rows.select("req_id", F.posexplode(parts).alias("pos", "sub_text"))
