import math
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from canopy.llm import license_scan as L
from canopy.llm.oracle_new import license_scan as sql

SCHEMA = "doc_id long, text string, row long, labels string, hits int"


def scan(spark, texts, **kw):
    frame = spark.createDataFrame([(k, t, 7, "x", 1) for k, t in enumerate(texts)], SCHEMA)
    return {r.doc_id: r for r in L.scan(frame, **kw).collect()}


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def base_places(text):
    own = words(text)
    return sorted((i, label) for phrase, label in L.BASE.items() for i in range(len(own))
                  if own[i:i + len(phrase.split())] == phrase.split())


def mit():
    return next(t for label, t, _ in L.TEMPLATES if label == "mit-text")


ODD = [None, "", "...", "MIT License", "mit licence", "mitK license", "MIT. LICENSE! mit-license",
       "the gnu general public license, version 3 of it", "general public", "license mit",
       "apache license apache license mit license", "über die mit license é", "x " * 3000
       + "Apache License"]


def test_base_places_of_odd_texts(spark):
    got = scan(spark, ODD)
    assert len(got) == len(ODD)
    for k, text in enumerate(ODD):
        want = base_places(text)
        r = got[k]
        assert (r.n_words, r.n_base) == (len(words(text)), len(want))
        assert r.first_word == (want[0][0] if want else None)
        assert r.last_word == (want[-1][0] if want else None)
        assert r.base_labels == ",".join(sorted({x for _, x in want}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1


def test_every_template_is_found_whole_and_edited(spark):
    texts = [f"intro line. {t} closing words" for _, t, _ in L.TEMPLATES]
    # their key phrases hold the edited words
    edited = [t.replace("copy", "duplicate").replace("conditions", "terms", 1)
              if len(L.words_of(t)) > 30 and label not in ("bsd", "isc") else t
              for label, t, _ in L.TEMPLATES]
    got = scan(spark, texts + edited)
    for k, (label, _, _) in enumerate(L.TEMPLATES * 2):
        assert label in got[k].labels.split(","), (k, label)
        assert got[k].score > 0.7


def test_mandatory_phrase_missing_or_displaced(spark):
    missing = mit().replace("free of charge", "at no cost")
    broken = mit().replace("without restriction", "very " * 6 + "without restriction")
    cut = mit()[:200]  # both phrases stand, but too little of the template
    got = scan(spark, [mit(), missing, broken, cut])
    assert [("mit-text" in got[k].labels) for k in range(4)] == [True, False, False, False]


def test_rare_words_weigh_more():
    weight = {"mit": 5, "license": 9, "the": 1}
    assert L.indexed_words(["mit", "license"], weight, True) == {"license"}
    assert L.indexed_words(["the", "mit", "the", "license"], weight, False) == {"license"}
    assert L.indexed_words(["the"] * 9 + ["mit"], weight, False) == {"mit"}


def brute(texts, known):
    """Weigh every pattern at every place of every text."""
    lists = [words(t) for t in texts]
    vocabulary = {w for p in known for w in p.words}
    weight = {w: math.floor(1000 * math.log((len(texts) + 1) / (
        sum(w in x for x in lists) + 1)) + 0.5) + 1 for w in vocabulary}
    out = []
    for own in lists:
        def held(p, at, own=own):
            return sum(weight[w] for k, w in enumerate(p.words)
                       if 0 <= at + k < len(own) and own[at + k] == w)
        found, stands = set(), {}
        for p in known:
            total = sum(weight[w] for w in p.words)
            for at in range(-len(p.words), len(own)):
                if p.whole and held(p, at) == total:
                    stands.setdefault(p.number, []).append(at)
                    found |= {(p.label, at, 1.0)} if p.label else set()
        for p in known:
            total = sum(weight[w] for w in p.words)
            for at in range(-len(p.words), len(own)):
                if not p.whole and held(p, at) * 10 >= total * L.LEAST_SHARE and all(
                        any(abs(x - k - at) <= L.SLACK for x in stands.get(n, []))
                        for n, k in p.keys):
                    found.add((p.label, at, held(p, at) / total))
        out.append(found)
    return out


SMALL = [("one", "red green blue green red", ["green blue"]),
         ("two", "green red red blue red green", ["red red", "red green"])]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["red", "green", "blue", "x"]), max_size=14)
                .map(" ".join), min_size=1, max_size=6))
def test_equals_brute_force_on_small_words(spark, texts):
    base = {"red green": "rg"}
    got = scan(spark, texts, base=base, templates=SMALL)
    want = brute(texts, L.patterns(base, SMALL))
    for k, found in enumerate(want):
        assert got[k].labels == ",".join(sorted({x[0] for x in found}))
        assert got[k].n_base == sum(x[0] == "rg" for x in found)
        assert got[k].score == pytest.approx(max((x[2] for x in found), default=0.0))


def test_equals_sql(spark):
    texts = ODD + [t for _, t, _ in L.TEMPLATES] + [mit() * 3, mit().upper()]
    got = scan(spark, texts)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    cursor = con.execute(sql(L.patterns()))
    names = [c[0] for c in cursor.description]
    for row in cursor.fetchall():
        want = dict(zip(names, row, strict=True))
        assert {c: got[want["doc_id"]][c] for c in names} == pytest.approx(want)


def test_empty_table_and_no_python_in_the_plan(spark, capsys):
    assert scan(spark, []) == {}
    frame = spark.createDataFrame([(1, "mit license")], "doc_id long, text string")
    L.scan(frame).explain("formatted")
    plan = capsys.readouterr().out
    assert "MapInArrow" not in plan and "Python" not in plan


def test_a_key_phrase_must_be_in_its_template():
    with pytest.raises(ValueError, match="not in the template"):
        L.patterns(L.BASE, [("x", "some words", ["other words"])])
