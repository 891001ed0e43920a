"""License scans (13): a positional rare-token index over licence templates, DataFrame
functions only.

A pattern is a sequence of words: the base phrases, the templates (licence notices and texts)
and the templates' mandatory key phrases.  The scan keeps, of every text, the positions of the
patterns' words (all their words, so neighbours stay neighbours), and counts in how many
texts each occurs.  Weights are integers: 1000 * ln((N + 1) / (df + 1)) + 1, rounded.

* Index: of each pattern its highest-IDF words, as many as weigh more than what a match may
  lack together.  A place that reaches the least share so matches one of them at least, and
  nothing is lost by looking up these alone.
* Look-up: a text's words that are indexed meet their postings (pattern, offset); the place of
  a posting is its text position less the offset.
* A phrase stands where all its words do, at their relative positions.
* A template stands at a place where each of its key phrases stands within ``SLACK`` words of
  its due position, and the words that stand where the template has them weigh ``LEAST_SHARE``
  of it at least.

Joins of places are equality joins on (row, pattern, place); slack is written out as rows, so
a text with many places forms no pairs.  Broadcast tables hold the patterns alone.

Defined cases: a null text is empty: no words, no labels, score 0; a null doc_id stays null;
repeated rows are scanned each; a place before the text's first word counts for a template of
which the beginning is missing; texts in other scripts have words like any other; further
columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm.common import stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LEAST_SHARE = 7  # tenths of a template's weight
SLACK = 2

# ---- fixed values: base phrases with their labels ----
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# ---- fixed values: licence notices as their authors publish them, with key phrases ----
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0",
     ["apache license version 2 0"]),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not
use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License.""",
     ["use this file except in compliance with the license", "unless required by applicable law"]),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification,
are permitted provided that the following conditions are met: 1. Redistributions of source code
must retain the above copyright notice, this list of conditions and the following disclaimer. 2.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions
and the following disclaimer in the documentation and/or other materials provided with the
distribution.""",
     ["redistribution and use in source and binary forms",
      "provided that the following conditions are met"]),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2",
     ["gnu general public license version 2"]),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3",
     ["gnu general public license version 3"]),
    ("gpl-or-later", """This program is free software: you can redistribute it and/or modify it
under the terms of the GNU General Public License as published by the Free Software Foundation,
either version 3 of the License, or (at your option) any later version.""",
     ["this program is free software", "at your option any later version"]),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose
with or without fee is hereby granted, provided that the above copyright notice and this
permission notice appear in all copies.""",
     ["permission to use copy modify", "with or without fee is hereby granted"]),
    ("mit-notice", "Released under the MIT License", ["under the mit license"]),
    ("mit-text", """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal in the Software
without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright
notice and this permission notice shall be included in all copies or substantial portions of the
Software.""",
     ["permission is hereby granted free of charge", "to deal in the software without restriction"]),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License,
v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
http://mozilla.org/MPL/2.0/.""",
     ["mozilla public license v 2 0"]),
    ("unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software""",
     ["unencumbered software released into the public domain"]),
]


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


@dataclass
class Pattern:
    number: int
    words: list[str]
    whole: bool  # a phrase: every word has to stand
    label: str | None  # of base phrases and templates
    base: bool = False
    keys: list[tuple[int, int]] = field(default_factory=list)  # (phrase number, offset)


def patterns(base: dict[str, str] = BASE, templates: list = TEMPLATES) -> list[Pattern]:
    """Base phrases, key phrases and templates, numbered; a phrase listed twice stands once."""
    out: list[Pattern] = []
    phrases: dict[tuple[str, ...], int] = {}
    for text, label in base.items():
        phrases[tuple(words_of(text))] = len(out)
        out.append(Pattern(len(out), words_of(text), True, label, True))
    for label, text, keys in templates:
        words, own = words_of(text), []
        for key in map(words_of, keys):
            places = [i for i in range(len(words)) if words[i:i + len(key)] == key]
            if not places:
                raise ValueError(f"key phrase {' '.join(key)!r} is not in the template {label}")
            if tuple(key) not in phrases:
                phrases[tuple(key)] = len(out)
                out.append(Pattern(len(out), key, True, None))
            own.append((phrases[tuple(key)], places[0]))
        out.append(Pattern(len(out), words, False, label, keys=own))
    return out


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small literal table."""
    def one(x) -> str:
        return f"'{x}'" if isinstance(x, str) else str(x).lower()
    listed = ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {listed} AS t({schema})")


def positions(docs: DataFrame, vocabulary: list[str], id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """(row, doc_id, n_words, hits): the places of the vocabulary's words, ascending; stored.

    ``lower`` maps one more character to an ASCII letter than A-Z, the Kelvin sign; it is
    replaced by another letter first.  Word bounds are the same before and after ``lower``.
    """
    text = F.lower(F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("K"),
                             F.lit("ā")))
    split = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    # one-element generator: the array of words is computed once
    once = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array(split)).alias("words"))
    placed = F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("word")))
    return stored(once.select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.filter(placed, lambda x: x["word"].isin(vocabulary)).alias("hits")), "license-hits")


def weights(scanned: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """IDF weight of each vocabulary word; one row a word comes to the driver."""
    total = scanned.count()
    counts = scanned.select(F.explode(F.array_distinct("hits.word")).alias("word")) \
        .groupBy("word").agg(F.count("*").alias("n")).collect()
    df = {r["word"]: r["n"] for r in counts}
    return {w: math.floor(1000 * math.log((total + 1) / (df.get(w, 0) + 1)) + 0.5) + 1
            for w in vocabulary}


def indexed_words(words: list[str], weight: dict[str, int], whole: bool) -> set[str]:
    """The highest-IDF words that weigh more than a match may lack (phrases lack nothing)."""
    spare = 0 if whole else sum(weight[w] for w in words) * (10 - LEAST_SHARE)
    out, held = set(), 0
    for w in sorted(set(words), key=lambda w: (-weight[w], w)):
        if 10 * held > spare:
            break
        out.add(w)
        held += weight[w] * words.count(w)
    return out


def places(docs: DataFrame, known: list[Pattern]) -> tuple[DataFrame, DataFrame]:
    """(scanned texts, (row, pattern, start, share) of all phrases and templates that stand)."""
    spark = docs.sparkSession
    vocabulary = sorted({w for p in known for w in p.words})
    scanned = positions(docs, vocabulary)
    weight = weights(scanned, vocabulary)
    index = {p.number: indexed_words(p.words, weight, p.whole) for p in known}
    postings = F.broadcast(_values(
        spark, [(w, p.number, k) for p in known for k, w in enumerate(p.words)
                if w in index[p.number]], "word, pattern, offset"))
    full = F.broadcast(_values(
        spark, [(p.number, k, w, weight[w]) for p in known for k, w in enumerate(p.words)],
        "pattern, offset, word, weight"))
    rare = sorted(set().union(*index.values()))
    looked_up = scanned.select(
        "row", F.explode(F.filter("hits", lambda x: x["word"].isin(rare))).alias("x")) \
        .select("row", "x.at", "x.word")
    starts = stored(looked_up.join(postings, "word").select(
        "row", "pattern", (F.col("at") - F.col("offset")).alias("start")).distinct(),
        "license-starts")

    def matched(candidates: DataFrame) -> DataFrame:
        """Candidates with the weight of their words that stand in place."""
        rows = candidates.select("row").distinct()
        near = scanned.join(rows, "row", "left_semi").select(
            "row", F.explode("hits").alias("x")).select("row", "x.at", "x.word")
        due = candidates.join(full, "pattern").withColumn("at", F.col("start") + F.col("offset"))
        return due.join(near, ["row", "at", "word"]).groupBy("row", "pattern", "start").agg(
            F.sum("weight").alias("held"))

    phrase_ids = [p.number for p in known if p.whole]
    totals = {p.number: sum(weight[w] for w in p.words) for p in known}
    whole = F.element_at(F.array(*(F.lit(totals[p.number]) for p in known)),
                         F.col("pattern") + 1)
    phrases = stored(matched(starts.filter(F.col("pattern").isin(phrase_ids)))
                     .filter(F.col("held") == whole).drop("held"), "license-phrases")
    # where a template has to start for a key phrase to stand within the slack
    keys = [(k, p.number, offset) for p in known for k, offset in p.keys]
    templates = starts.filter(~F.col("pattern").isin(phrase_ids))
    if keys:
        due = phrases.withColumnRenamed("pattern", "key").join(F.broadcast(_values(
            spark, keys, "key, pattern, offset")), "key").select(
            "row", "pattern", "key", F.explode(F.sequence(
                F.col("start") - F.col("offset") - SLACK,
                F.col("start") - F.col("offset") + SLACK)).alias("start"))
        needed = F.element_at(F.array(*(F.lit(max(1, len({k for k, _ in p.keys})))
                                        for p in known)), F.col("pattern") + 1)
        verified = due.groupBy("row", "pattern", "start").agg(
            F.count_distinct("key").alias("n")).filter(F.col("n") == needed).drop("n")
        templates = templates.join(verified, ["row", "pattern", "start"])
    standing = matched(templates).filter(F.col("held") * 10 >= whole * LEAST_SHARE).select(
        "row", "pattern", "start", (F.col("held") / whole).alias("share"))
    return scanned, phrases.withColumn("share", F.lit(1.0)).unionByName(standing)


def scan(docs: DataFrame, base: dict[str, str] = BASE, templates: list = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found) of
    each row; ``found`` lists the label, first word and share of all that stands."""
    known = patterns(base, templates)
    scanned, standing = places(docs, known)
    label = F.element_at(F.array(*(F.lit(p.label) for p in known)), F.col("pattern") + 1)
    is_base = F.col("pattern").isin([p.number for p in known if p.base])
    named = standing.withColumn("label", label).filter("label IS NOT NULL")

    def listed(values: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(values)), ",")

    # a text with very many places is summed up by label and pattern before
    per_pattern = named.groupBy("row", "pattern", "label").agg(
        F.count("*").alias("n"), F.min("start").alias("first"), F.max("start").alias("last"),
        F.max("share").alias("share"))
    per_row = per_pattern.groupBy("row").agg(
        F.sum(F.when(is_base, F.col("n"))).alias("n_base"),
        F.min(F.when(is_base, F.col("first"))).alias("first_word"),
        F.max(F.when(is_base, F.col("last"))).alias("last_word"),
        listed(F.when(is_base, F.col("label"))).alias("base_labels"),
        listed(F.col("label")).alias("labels"), F.max("share").alias("score"),
        F.array_sort(F.collect_list(F.struct("label", "first", "share", "n"))).alias("found"))
    return scanned.join(per_row, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), "found")
