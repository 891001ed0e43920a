import random

import pyarrow as pa
import pytest

from canopy.llm import decontaminate as D
from canopy.llm.common import strings

from .brute import contamination, words


def frames(spark, docs, items):
    return (spark.createDataFrame([(a, b, "x", 3) for a, b in docs],
                                  "doc_id long, text string, item_id string, start int"),
            spark.createDataFrame([(a, b, 1) for a, b in items],
                                  "item_id long, text string, doc_id int"))


def test_words_equal_pattern():
    texts = ["Ab cd-EF", "", "é中文 x9", "a\tb\n", "ÀÉ z", "  lead", "end  "]
    hashes, bounds = D.word_hashes(strings(pa.array(texts)))
    names = [words(t) for t in texts]
    assert [b - a for a, b in zip(bounds, bounds[1:])] == [len(x) for x in names]
    flat = [w for x in names for w in x]
    assert len({(w, h) for w, h in zip(flat, hashes.tolist())}) == len(set(flat))


def test_hashes_do_not_depend_on_chunks():
    texts = strings(pa.array(["some words of a text " * 50, "more " * 30]))
    assert (D.word_hashes(texts)[0] == D.word_hashes(texts, chunk=64)[0]).all()


@pytest.mark.parametrize("block_words", [2_000_000, 20])
def test_equals_brute_force(spark, block_words):
    rng = random.Random(block_words)
    vocabulary = ["a", "b", "c", "dd", "ee", "f1", "gé"]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, line(rng.choice([1, 3, 10, 11, 14, 30]))) for i in range(12)] + [
        (12, None), (13, "..."), (None, "a b"), (14, "zz zz"), (3, line(12))]
    docs = [(i, line(rng.choice([2, 20, 60]))) for i in range(30)]
    docs += [(100 + i, f"x {(t or '').upper()}; {t or ''} y") for i, (_, t) in enumerate(items)]
    docs += [(200, None), (201, ""), (5, docs[5][1]), (5, items[3][1]), (None, items[4][1])]
    documents, benchmark = frames(spark, docs, items)
    counts, found = D.find_matches(documents, benchmark, block_words=block_words)
    assert len(found) >= 1
    got = D.decontaminate(documents, benchmark).collect()
    want = sorted((str(d), *contamination(t, items)) for d, t in docs)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in got) == want
    assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items"]) for r in got)


def test_blocks_of_items_give_the_same_matches(spark):
    items = [(i, f"one two{i} three four five six seven eight nine ten eleven{i}")
             for i in range(9)]
    documents, benchmark = frames(spark, [(i, t) for i, t in items], items)
    whole = D.find_matches(documents, benchmark)[1]
    parts = D.find_matches(documents, benchmark, block_words=40)[1]
    assert len(whole) == 1 and len(parts) > 1
    rows = lambda fs: sorted(tuple(r) for f in fs for r in f.collect())
    assert rows(whole) == rows(parts)


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(1, "x " + " ".join(reversed(item.split())) + " y"), (2, item),
            (3, item.replace("gamma", "gamma extra words here")), (4, "alpha beta " * 9)]
    documents, benchmark = frames(spark, docs, [(7, item)])
    got = {(r.doc_id, r.kind, r.start) for f in D.find_matches(documents, benchmark, slop=4)[1]
           for r in f.collect()}
    assert got == {(1, "proximity", 1), (2, "phrase", 0), (2, "proximity", 0),
                   (3, "proximity", 0)}


def test_empty_tables(spark):
    documents, benchmark = frames(spark, [(1, "a b")], [(1, "a")])
    assert D.decontaminate(documents.limit(0), benchmark).count() == 0
    row = D.decontaminate(documents, benchmark.limit(0)).first()
    assert (row.n_words, row.n_hit, row.contaminated) == (2, 0, False)
