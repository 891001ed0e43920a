import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from canopy.llm import filter_audit as A

SCHEMA = "doc_id long, text string, lang string, n long, fails string"
LABELS = "doc_id long, quality int, toxic int, part string"


def brute(rows, labels):
    """Apply every order to every part's documents, one after the other."""
    def fails(i, doc_id, text):
        text = text or ""
        words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text).split(" ")
                 if w]
        out = set()
        if len(words) < A.MIN_WORDS:
            out.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            out.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text):
            out.add("C")
        if any(c in "#$%&*|" for c in text):
            out.add("D")
        if any(d is not None and doc_id is not None and d < doc_id and (t or "") == text
               for d, t, _ in rows):
            out.add("E")
        return out

    every = [(lang or "", fails(i, d, t),
              any(q == 1 for x, q, _ in labels if x == d and d is not None),
              any(q == 1 for x, _, q in labels if x == d and d is not None))
             for i, (d, t, lang) in enumerate(rows)]
    out = {}
    for part in {x[0] for x in every}:
        own = [x for x in every if x[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in x[1] for x in own) - len(gone),
                    sum(x[1] == {f} for x in own), sum(x[2] for x in gone),
                    sum(x[3] for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def check(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    marks = spark.createDataFrame([(*r, "y") for r in labels], LABELS)
    got = A.audit(docs, marks).collect()
    found = {(r.part, r.filter_order, r.step): [
        r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley]
        for r in got}
    assert len(found) == len(got)
    assert found == brute(rows, labels)


def sample(rng, n):
    vocabulary = [f"w{k}" for k in range(400)]
    texts = [None, "", " ", "ABC", "abc # def", "é" * 5 + "AB"]
    for _ in range(n):
        words = rng.choices(vocabulary[:rng.choice([20, 400])], k=rng.choice([3, 99, 100, 120]))
        if rng.random() < 0.3:
            words = [w.upper() for w in words]
        if rng.random() < 0.3:
            words.append("$")
        texts.append(rng.choice([" ", "\n", "\t "]).join(words))
    ids = [None, None, 1, 1, *range(2, n)]
    return [(rng.choice(ids), rng.choice(texts), rng.choice(["en", "de", None, ""]))
            for _ in range(2 * n)]


@pytest.mark.parametrize("size", [1 << 16, 4])
def test_equals_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(A, "RANGE", size)
    rng = random.Random(size)
    rows = sample(rng, 40)
    labels = [(rng.choice([None, *range(40)]), rng.choice([0, 1, None]),
               rng.choice([0, 1, None])) for _ in range(60)]
    check(spark, rows, labels)


def test_no_labels_one_document_and_empty_table(spark):
    check(spark, [(5, "a b", "en")], [])
    check(spark, [], [(1, 1, 1)])


def test_many_copies_in_one_part(spark, monkeypatch):
    monkeypatch.setattr(A, "RANGE", 16)
    check(spark, [(k % 50, "same text here", "en") for k in range(120)], [(3, 1, 0)])


def test_a_text_in_pieces_has_the_figures_of_the_whole(monkeypatch):
    rng = random.Random(5)
    texts = pa.array([" ".join(rng.choices(["Ab", "b", "cé", "d$", "efg"], k=n))
                      for n in (0, 3, 500, 2, 900)], pa.large_string())
    whole = A._figures(texts)
    cut = A.text_pieces
    monkeypatch.setattr(A, "text_pieces", lambda x: cut(x, 64))
    for a, b in zip(whole, A._figures(texts), strict=True):
        assert a.tolist() == b.tolist()


ids = st.lists(st.integers(0, 60), unique=True).map(lambda x: np.asarray(sorted(x), np.int64))


@settings(max_examples=150, deadline=None)
@given(st.lists(ids, max_size=5), ids, ids)
def test_merges_equal_set_operations(lists, a, b):
    assert A.union(lists).tolist() == sorted(set().union(*(x.tolist() for x in lists)))
    assert A.difference(a, b).tolist() == sorted(set(a.tolist()) - set(b.tolist()))
    assert A.overlap(a, b) == len(set(a.tolist()) & set(b.tolist()))


def test_galloping_over_long_lists():
    rng = np.random.default_rng(1)
    for n, m in ((10, 100_000), (5_000, 100_000), (100_000, 7)):
        a = np.unique(rng.integers(0, 1 << 40, n))
        b = np.unique(np.concatenate([rng.integers(0, 1 << 40, m), a[::3]]))
        assert A.difference(a, b).tolist() == np.setdiff1d(a, b).tolist()
        assert A.overlap(a, b) == len(np.intersect1d(a, b))
