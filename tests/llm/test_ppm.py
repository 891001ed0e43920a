import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from canopy.llm import ppm, queries
from canopy.llm.common import id_remainder, strings

from .brute import LOWER, tokens

SF = "/root/testdata/sf0.001"


def brute_counts(texts, order):
    counts = defaultdict(Counter)
    for text in texts:
        data = b"\xff" * order + (text or "").translate(LOWER).encode() + b"\xff"
        for i in range(order, len(data)):
            for k in range(order + 1):
                counts[data[i - k:i]][data[i]] += 1
    return counts


def brute_log10(text, counts, order, least):
    data = b"\xff" * order + (text or "").translate(LOWER).encode() + b"\xff"
    total = 0.0
    for i in range(order, len(data)):
        excluded = set()
        for k in range(order, -1, -1):
            node = counts.get(data[i - k:i], {})
            kept = {s: n for s, n in node.items() if n >= least}
            if not kept:
                continue
            live = {s: n for s, n in kept.items() if s not in excluded}
            dropped = sum(n for n in node.values() if n < least)
            escape = len(live) / 2 + dropped
            whole = sum(live.values()) + dropped
            if data[i] in live:
                total += math.log10((live[data[i]] - 0.5) / whole)
                break
            if whole:
                total += math.log10(escape / whole)
            excluded |= set(kept)
        else:
            total -= math.log10(256 - len(excluded))
    return total


@pytest.fixture(scope="module")
def texts():
    return ["The cat sat on the mat. The cat ate.", "the dog sat", None, "", "thé mat\n\nthe Cat"]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)],
                                 "doc_id long, text string, n int, word string")


def whole_trie(spark, texts, order, hot_share=None):
    """The trie that one shard of all strings has."""
    docs = docs_of(spark, texts)
    roots = ppm.learn_roots(docs, F.lit(True), order)
    grams = ppm.count_grams(docs, F.lit(True), order).toArrow()
    return roots.trie(grams.column("gram").to_numpy().view(np.uint64),
                      grams.column("n").to_numpy(), order)


def test_trie_equals_brute_force(spark, texts):
    trie = whole_trie(spark, texts, 3)
    counts = brute_counts(texts, 3)
    for text in [*texts, "a strange Text with the cat", "zzz", "\x00"]:
        got = sum(trie.log10(g).sum() for g, _ in ppm._grams(strings(pa.array(
            [text], pa.string())), 3))
        assert got == pytest.approx(brute_log10(text, counts, 3, 1), abs=1e-9)


def test_probabilities_sum_to_one(spark, texts):
    trie = whole_trie(spark, texts, 3)
    for context in (b"the", b"t s", b"zzz", b"\xff\xff\xff", b"e c"):
        base = int.from_bytes(context, "big") << 8
        grams = np.asarray([base | s for s in range(256)], np.uint64)
        assert (10 ** trie.log10(grams)).sum() == pytest.approx(1, abs=1e-9)


def test_packed_strings_come_back():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5000):
        gram = np.unique(rng.integers(0, 1 << 56, n, dtype=np.uint64))
        turned = np.sort(ppm._turned(gram))
        assert (ppm._unpacked(ppm._packed(turned), np.uint64) == turned).all()
        assert (np.sort(ppm._unturned(turned)) == gram).all()


def test_runs_add_up():
    rng = np.random.default_rng(3)
    runs, want = ppm._Runs(), Counter()
    for _ in range(40):
        value, n = np.unique(rng.integers(0, 500, rng.integers(0, 90)).astype(np.uint64),
                             return_counts=True)
        want.update(dict(zip(value.tolist(), n.tolist(), strict=True)))
        runs.add(value, n)  # may change the arrays
    value, n = runs.take()
    assert not runs.runs
    assert dict(zip(value.tolist(), n.tolist(), strict=True)) == want
    assert (np.diff(value.astype(np.int64)) > 0).all()


def test_chunks_do_not_matter(texts):
    array = strings(pa.array([*texts, "long text " * 100]))
    whole = [np.concatenate(x) for x in zip(*ppm._grams(array, 4))]
    parts = [np.concatenate(x) for x in zip(*ppm._grams(array, 4, chunk=13))]
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_table_of_many_keys():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 40, 50_000, dtype=np.uint64))
    table = ppm.Table(keys[::2])
    assert (table.find(keys[::2]) == np.arange(len(keys[::2]))).all()
    assert (table.find(keys[1::2]) == -1).all()


def test_base_model(spark, monkeypatch):
    monkeypatch.setattr(ppm, "WORD_BITS", 6)  # most words are rare: they go through the join
    rows = [(i, t) for i, t in enumerate(["a b b", "A c\x0bd", None, "", "zz a", "b " * 50])]
    rows += [(1, "A c\x0bd"), (None, "q q")]
    docs = spark.createDataFrame([(a, b, 0) for a, b in rows],
                                 "doc_id long, text string, row int")
    learn = id_remainder("doc_id", 10) != 0
    got = ppm.score(docs, learn).collect()
    held = {r.doc_id: r.held_out for r in got}
    assert held[None]
    train = Counter(t for d, x in rows if not held[d] for t in [*tokens(x), None])
    n, v = sum(train.values()), len(train)
    want = sorted((str(d), len(tokens(x)) + 1, sum(train[t] > 0 for t in [*tokens(x), None]),
                   round(sum(math.log10((train[t] + 0.1) / (n + 0.1 * (v + 1)))
                             for t in [*tokens(x), None]), 6)) for d, x in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6))
                  for r in got) == want
    assert {r.train_tokens for r in got} == {n}


def test_model_beats_base_on_held_out_text(spark):
    sums = queries.op3_lm_scoring(spark, "/root/testdata/sf0.01").filter("held_out").agg(
        F.sum("score"), F.sum("base_score")).first()
    assert sums[0] > sums[1]


def test_nothing_learned_and_empty(spark):
    docs = docs_of(spark, ["ab", None])
    got = {r.doc_id: r for r in ppm.score(docs, F.lit(False)).collect()}
    assert got[0].score == pytest.approx(-3 * math.log10(256))
    assert got[1].n_tokens == 1 and got[1].train_tokens == 0
    assert ppm.score(docs.limit(0), F.lit(True)).count() == 0


def test_adaptive_learns():
    once = ppm.adaptive_log10("abracadabra ")
    assert ppm.adaptive_log10("abracadabra " * 10) > 4 * once
    assert ppm.adaptive_log10("") == pytest.approx(-math.log10(256))
