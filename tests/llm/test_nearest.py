import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.llm import nearest as N


def brute(rows, k):
    """One list for each query row, over all other rows."""
    kept = [(i, v) for i, v in rows if i is not None and v
            and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for n, (q, x) in enumerate(kept):
        if q % 20 == 0:
            pairs = sorted((-float(np.dot(np.float64(x), np.float64(y))), i)
                           for m, (i, y) in enumerate(kept) if m != n and len(y) == len(x))
            out += [(q, rank, i, round(-s, 9)) for rank, (s, i) in enumerate(pairs[:k], 1)]
    return sorted(out)


def check(spark, rows, k=5):
    frame = spark.createDataFrame([(i, v, 1.0, 2) for i, v in rows],
                                  "vec_id long, embedding array<float>, score double, row int")
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 9))
           for r in N.nearest(frame, F.col("vec_id") % 20 == 0, k).collect()]
    want = brute([(i, None if v is None else [None if x is None else float(np.float32(x))
                                              for x in v]) for i, v in rows], k)
    assert [x[:3] for x in sorted(got)] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in sorted(got)], [x[3] for x in want], rtol=1e-9, atol=1e-8)


def test_all_rows_of_a_repeated_id_are_candidates(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.8, 0.0]), (1, [0.5, 0.0]), (1, [0.9, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = N.nearest(frame, F.col("vec_id") % 20 == 0).collect()
    assert len(got) == 6
    assert max(r.score for r in got if r.vec_id == 1) == pytest.approx(0.9)
    assert sorted(round(r.score, 4) for r in got if r.vec_id == 20) == [0.8, 0.8]
    check(spark, rows)


@pytest.mark.parametrize("block,tile", [(8192, 4096), (3, 7)])
def test_equals_brute_force(spark, monkeypatch, block, tile):
    monkeypatch.setattr(N, "QUERY_BLOCK", block)
    monkeypatch.setattr(N, "TILE", tile)
    rng = np.random.default_rng(block)
    rows = [(i, (rng.normal(size=16) * 10.0 ** rng.integers(-3, 4)).tolist())
            for i in range(300)]
    check(spark, rows)


def test_ties_and_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 1.0]), (7, [2.0, 0.0]), (3, [2.0, 0.0]), (5, [2.0, 9.0]),
            (9, None), (10, []), (11, [0.0, 0.0]), (12, [None, 1.0]), (13, [float("nan"), 1.0]),
            (14, [float("inf"), 1.0]), (None, [5.0, 5.0]), (7, [2.0, 0.0]), (3, [1.5, 0.0]),
            (40, [1.0, 2.0, 3.0]), (41, [1.0, 2.0, 3.0]), (60, [4.0])]
    check(spark, rows)


def test_many_equal_vectors(spark):
    rng = random.Random(1)
    rows = [(i, [0.5, -0.25, 1.0]) for i in range(200)]
    rows += [(1000 + i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(50)]
    check(spark, rows, 20)


def test_bounds_hold():
    rng = np.random.default_rng(0)
    a, b = N._Quantised(rng.normal(size=(40, 2100))), N._Quantised(rng.normal(size=(60, 2100)))
    product, bound = N._tile(a, b)
    assert (np.abs(product - a.x @ b.x.T) <= bound).all()


def test_empty(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert N.nearest(frame, F.col("vec_id") % 20 == 0).count() == 0
