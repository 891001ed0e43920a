import math

import numpy as np
import pytest

from canopy.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code string, v long"


def brute(rows, entries=V.ENTRIES):
    """The contract, one vector after the other."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in e], lab) for i, e, lab in rows
            if e and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], []
    d = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == d]
    cut = [d * k // 4 for k in range(5)]
    parts = [[np.array(r[1][a:b], dtype=object) for r in kept] for a, b in zip(cut, cut[1:])]
    books = [p[:entries] for p in parts]

    def near(x, book):
        return min((sum((x - e) ** 2) if len(x) else 0, k) for k, e in enumerate(book))

    for _ in range(4):
        for k in range(4):
            of = [near(x, books[k])[1] for x in parts[k]]
            new = list(books[k])
            for c in set(of):
                own = [x for x, y in zip(parts[k], of, strict=True) if y == c]
                new[c] = np.array([int(s) // len(own) for s in sum(own)], dtype=object)
            books[k] = new
    out = []
    for n, (i, _, lab) in enumerate(kept):
        found = [near(parts[k][n], books[k]) for k in range(4)]
        out.append([i, lab, [c for _, c in found], sum(e for e, _ in found)])
    for r in out:
        r.append(sum(x[3] for x in out if x[1] == r[1]))
    return out, books


def check(spark, rows, entries=V.ENTRIES):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    coded, books = V.encode(frame)
    want, want_books = brute(rows, entries)
    got = [[r.vec_id, r.label, list(r.codes), r.error, r.label_error] for r in coded.collect()]
    key = repr
    assert sorted(got, key=key) == sorted(want, key=key)
    assert [[list(map(int, e)) for e in b] for b in want_books] == [b.tolist() for b in books][
        :len(want_books)]


@pytest.mark.parametrize("width,scale", [(16, 0.3), (10, 40.0), (64, 0.1)])
def test_equals_brute_force(spark, width, scale):
    rng = np.random.default_rng(width)
    centres = rng.normal(size=(6, width)) * scale
    rows = [(int(k), (centres[k % 6] + rng.normal(size=width) * scale / 4).tolist(), int(k % 3))
            for k in rng.permutation(290)]
    check(spark, rows)


def test_odd_rows(spark):
    rows = [(1, [1.0, 2.0, 3.0, 4.0], 1), (1, [1.0, 2.0, 3.0, 4.0], None), (1, [0.5] * 4, 1),
            (None, [9.0, 9.0, 9.0, 9.0], None), (2, None, 1), (3, [], 1),
            (4, [None, 1.0, 1.0, 1.0], 1), (5, [float("nan")] * 4, 1),
            (6, [float("inf"), 0.0, 0.0, 0.0], 1), (7, [1.0, 2.0], 1), (8, [0.0] * 4, 2),
            (9, [-0.0001, -1.5, 0.0001, 7.0], 2)]
    check(spark, rows)
    check(spark, [])
    check(spark, [(2, None, 1)])


def test_many_equal_vectors_and_more_rows_than_entries(spark):
    rows = [(k, [0.25, -0.5, 0.75, 1.0, 0.0, 0.0, 0.1, 0.2], 0) for k in range(300)]
    rows += [(300 + k, [0.01 * k] * 8, 1) for k in range(60)]
    check(spark, rows)


def test_memo_changes_nothing_and_saves_work(monkeypatch):
    rng = np.random.default_rng(3)
    entries = rng.integers(-300, 300, (256, 16))
    x = np.concatenate([entries + rng.integers(-20, 20, entries.shape) for _ in range(4)])
    distance = ((x[:, None, :] - entries[None]) ** 2).sum(2)
    for cells in (V.MEMO_CELLS, 10, 0):
        monkeypatch.setattr(V, "MEMO_CELLS", cells)
        book = V.Codebook(entries)
        for _ in range(2):
            code, error = book.nearest(x)
            assert code.tolist() == distance.argmin(1).tolist()
            assert error.tolist() == distance.min(1).tolist()
        assert book.evaluated < x.shape[0] * 256  # two passes over all entries would be twice that


def test_dominated_entries_are_never_nearest_in_the_box():
    rng = np.random.default_rng(4)
    book = V.Codebook(rng.integers(-60, 60, (20, 3)))
    cells = np.unique(rng.integers(-70, 70, (50, 3)) >> book.shift, axis=0)
    for cell, alive in zip(cells, book._candidates(cells), strict=True):
        low = cell << book.shift
        grid = np.stack(np.meshgrid(*(np.arange(a, a + (1 << book.shift)) for a in low)),
                        -1).reshape(-1, 3)
        best = ((grid[:, None] - book.entries[None]) ** 2).sum(2)
        assert set(np.flatnonzero((best == best.min(1)[:, None]).any(0))) <= set(alive)


def test_equal_hashes_are_told_apart():
    book = V.Codebook(np.arange(40).reshape(10, 4) * 100)
    book.mix = np.zeros(4, np.int64)
    x = np.random.default_rng(1).integers(-100, 4000, (200, 4))
    distance = ((x[:, None] - book.entries[None]) ** 2).sum(2)
    assert book.nearest(x)[0].tolist() == distance.argmin(1).tolist()
