"""Sources: request ingest (#1).

Spec ingest (#2) is in ``canopy.sources.specs``, log ingest (#3) in
``canopy.sources.logs`` and project ingest (#4) in ``canopy.operators.projects``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.functions import dims
from canopy.functions import text as T
from canopy.functions.frames import settle


def language_of(alias: F.Column, aliases=dims.LANGUAGE_ALIASES) -> F.Column:
    """Language of an alias (lowered and stripped); NULL when unsupported."""
    expr = None
    for a, lang in aliases:
        expr = F.when(alias == a, lang) if expr is None else expr.when(alias == a, lang)
    return expr


def ingest_requests(raw: DataFrame, aliases=dims.LANGUAGE_ALIASES) -> DataFrame:
    """Tag every request with language, normalised text, source and status.

    ``status`` is ``ok`` or the rejection text; the language check comes first.
    Returns one DataFrame; ``split_ingested`` gives (requests, rejects).  A null
    alias is an unsupported language and a null text is too short, so every row has
    a status.
    """
    # texts that many conditions read are computed once per row (see ``settle``)
    lowered = F.col("_lowered")
    return (
        raw.withColumn("_text", T.py_strip(F.col("text")))
        .withColumn("_alias", T.py_strip(F.lower("alias")))
        .transform(lambda d: settle(d, ["_text", "_alias"]))
        .withColumn("language", language_of(F.col("_alias"), aliases))
        .withColumn("norm_text", T.nfkc("_text"))
        .transform(lambda d: settle(d, ["norm_text", "language"]))
        .withColumn("_lowered", F.lower("norm_text"))
        .transform(lambda d: settle(d, ["_lowered"]))
        .withColumn("source", F.when(T.any_contains(lowered, dims.SPEC_MARKERS), "yaml_spec")
                    .otherwise("freetext"))
        .withColumn("status",
                    F.when(F.col("language").isNull(),
                           F.concat(F.lit("Unsupported language: "),
                                    F.coalesce("alias", F.lit("None"))))
                    .when(F.coalesce(F.length("norm_text"), F.lit(0)) < 3, "Intent too short")
                    .otherwise("ok"))
        .transform(lambda d: settle(d.select(*raw.columns, "language", "norm_text", "source",
                                             "status"),
                                    ["language", "norm_text", "source", "status"]))
    )


def split_ingested(ingested: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = F.col("status") == "ok"
    return ingested.where(ok), ingested.where(~ok)
