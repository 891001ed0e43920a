import random

import numpy as np
import pyarrow as pa
import pytest

from canopy.llm import simhash as S
from canopy.llm.common import strings

from .brute import components, fingerprint


def test_fingerprints_equal_brute_force(monkeypatch):
    texts = ["", " \t\n", "one", "one two", "One  two\x0bthree", "a b c d e " * 30, "é 中 x y",
             "same same same same"]
    want = [fingerprint(t) for t in texts]
    assert S.fingerprints(strings(pa.array(texts))).tolist() == want
    monkeypatch.setattr(S, "STEP", 7)
    assert S.fingerprints(strings(pa.array(texts))).tolist() == want


def near(rng, base, bits):
    return base ^ sum(1 << b for b in rng.sample(range(64), bits))


@pytest.mark.parametrize("split", [512, 12])
@pytest.mark.parametrize("dense", [False, True])
def test_links_equal_brute_force(spark, monkeypatch, split, dense):
    monkeypatch.setattr(S, "SPLIT", split)
    rng = random.Random(split + dense)
    fps = {rng.getrandbits(64) for _ in range(20)}
    for base in list(fps):
        fps |= {near(rng, base, k) for k in (1, 2, 3, 4, 3)}
    if dense:  # a group that differs in few places: large buckets
        base = rng.getrandbits(64)
        places = [0, 3, 31, 32, 33, 63]
        fps |= {base ^ sum(1 << p for k, p in enumerate(places) if m >> k & 1)
                for m in range(64)}
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {tuple(r) for r in S.link_pairs(frame).collect()}
    want = {(a, b) for a in signed for b in signed
            if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert got == want


def test_more_than_three_bits_are_refused(spark):
    with pytest.raises(ValueError):
        S.link_pairs(spark.createDataFrame([(1,)], "fp long"), 4)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200)], "a long, b long")
    got = dict(S.components(links).collect())
    assert got == {**{i: 0 for i in range(1, 41)}, 200: 100}


def rows_of():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for d in range(12):
        text = [rng.choice(words) for _ in range(300)]
        rows.append((d, " ".join(text)))
        if d % 3 == 0:
            text[rng.randrange(300)] = "changed"
            rows.append((50 + d, " ".join(text)))
            rows.append((70 + d, rows[-1][1]))
    return rows + [(200, None), (201, ""), (202, " \n"), (None, rows[0][1]), (None, "only null"),
                   (None, "only null"), (3, rows[3][1]), (300, "x " * 20000)]


def test_near_duplicates_equal_brute_force(spark):
    rows = rows_of()
    docs = spark.createDataFrame([(a, b, 1, "r") for a, b in rows],
                                 "doc_id long, text string, fp int, root string")
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id))
                 for r in S.near_duplicates(docs).collect())
    fp = {t: fingerprint(t) for _, t in rows}
    root = components(fp.values())
    signed = {t: int(np.uint64(x).astype(np.int64)) for t, x in fp.items()}
    least = {}
    for d, t in rows:
        if d is not None:
            r = root[signed[t]]
            least[r] = min(d, least.get(r, d))
    want = sorted((str(d), f"{fp[t]:016x}", str(least.get(root[signed[t]]))) for d, t in rows)
    assert got == want


def test_one_of_each(spark):
    rows = rows_of()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in S.one_of_each(docs).collect()]
    fp = {t: fingerprint(t) for _, t in rows}
    root = components(fp.values())
    of = lambda t: root[int(np.uint64(fp[t]).astype(np.int64))]
    assert sorted(of(t) for _, t in kept) == sorted({of(t) for _, t in rows})
    assert set(kept) <= set(rows)
    for d, t in kept:
        ids = [x for x, y in rows if of(y) == of(t) and x is not None]
        assert d == (min(ids) if ids else None)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(docs).count() == 0
    assert S.one_of_each(docs).count() == 0


def plans(monkeypatch, module, label=""):
    """Plans of what ``module`` stores from now on, of one label or all."""
    found, real = [], module.stored

    def watched(df, name):
        if label in name:
            found.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(module, "stored", watched)
    return found


def test_exploded_variants_are_never_broadcast(spark, monkeypatch):
    # Spark sizes the 66 variants of a fingerprint as little more than the fingerprint
    found = plans(monkeypatch, S, "simhash-buckets")
    frame = S.stored(spark.createDataFrame([(x,) for x in (0, 1, 3, 1 << 40, 5 << 50)], "fp long"), "f")
    assert {tuple(r) for r in S.link_pairs(frame).collect()} == {
        (0, 1), (0, 3), (1, 3), (0, 1 << 40), (1, 1 << 40), (3, 1 << 40), (0, 5 << 50), (1, 5 << 50),
        (1 << 40, 5 << 50)}
    assert found and not [p for p in found if "Broadcast" in p]


def test_groups_are_the_same_by_broadcast_and_by_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame(rows_of(), "doc_id long, text string")
    want = sorted(map(str, S.near_duplicates(docs).collect()))
    monkeypatch.setattr(S, "BROADCAST_ROWS", 0)
    found = plans(monkeypatch, S)
    got = S.near_duplicates(docs)
    assert sorted(map(str, got.collect())) == want
    found.append(got._jdf.queryExecution().executedPlan().toString())
    assert not [p for p in found if "Broadcast" in p]
