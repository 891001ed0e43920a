import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.llm import line_dedup, sharding

from .brute import line_dedup as brute_lines


def text_hashes(spark, texts):
    rows = spark.createDataFrame([(t,) for t in {x for x in texts if x is not None}], "t string")
    return dict(rows.select("t", F.xxhash64("t")).collect())


def line_rows():
    rng = random.Random(9)
    passage = ["shared one", "shared two", "shared three", "shared four"]
    rows = []
    for d in range(25):
        lines = [f"own line {d} {k}" for k in range(rng.randrange(6))]
        if d % 3 == 0:
            at = rng.randrange(len(lines) + 1)
            lines[at:at] = passage[:rng.choice([2, 3, 4])]
        if d % 5 == 0:
            lines.insert(1, "  ")
        rows.append((d, "\n".join(lines)))
    return rows + [(30, None), (31, ""), (32, "\n\n\n"), (33, "a\n" * 9), (34, "a\nb"),
                   (3, rows[3][1]), (6, "other\n" + "\n".join(passage)), (None, rows[9][1]),
                   (None, "x\ny\nz"), (40, "x\ny\nz"), (41, "\n".join(passage) + "\r\n" * 3),
                   (50, "\n".join(f"l{i}" for i in range(30_000)))]


def test_lines_equal_brute_force(spark):
    rows = line_rows()
    docs = spark.createDataFrame([(a, b, "k", 7) for a, b in rows],
                                 "doc_id long, text string, gone string, k1 int")
    got = line_dedup.remove_repeats(docs).collect()
    want = brute_lines(rows, text_hashes(spark, [t for _, t in rows]))
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted(
        (str(d), str(t)) for (d, _), t in zip(rows, want))
    assert all(r.gone == "k" and r.k1 == 7 for r in got)
    for r in got:
        if r.text is None:
            assert (r.n_lines, r.n_removed) == (0, 0)


def test_every_distinct_line_stays_somewhere(spark):
    rows = line_rows()
    got = line_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    lines = lambda texts: {x for t in texts if t for x in t.split("\n")}
    before = lines(t for _, t in rows)
    assert {x for x in before if x.strip()} <= lines(r.text for r in got.collect())


def test_lines_run_no_python(spark):
    docs = spark.createDataFrame(line_rows(), "doc_id long, text string")
    plan = line_dedup.remove_repeats(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def best_fit(sizes, capacity):
    """Plain best fit decreasing: number of bins."""
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms[rooms.index(min(fits))] -= s
        else:
            rooms.append(max(capacity, s) - s)
    return len(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 3, 5, 17, 40, 41, 99, 130]) for _ in range(200)]
    value, count = np.unique(sizes, return_counts=True)
    starts, names = sharding.plan(value, count, capacity=100)
    shard = names[np.searchsorted(starts, np.arange(200), side="right") - 1]
    assert len(set(shard)) == best_fit(sizes, 100)
    ordered = np.sort(sizes)[::-1]
    for b in set(shard):
        own = ordered[shard == b]
        assert own.sum() <= 100 or len(own) == 1


def test_tree_finds_tightest():
    rng = random.Random(0)
    bins, plain = sharding.Bins(), {}
    for name in range(300):
        room = rng.randrange(50)
        bins.add(room, name)
        plain[name] = room
        if name % 3 == 1:
            gone = rng.choice(list(plain))
            bins.remove(plain.pop(gone), gone)
        size = rng.randrange(60)
        fits = sorted((r, n) for n, r in plain.items() if r >= size)
        assert bins.tightest(size) == (fits[0] if fits else None)
        assert bins.emptiest()[0] == max(plain.values())


def test_shards(spark):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randrange(400)) for i in range(600)]
    rows += [(1000 + i, "hot " * 20) for i in range(300)] + [(None, None), (2000, ""), (2000, "")]
    docs = spark.createDataFrame([(a, b, 1, "p") for a, b in rows],
                                 "doc_id long, text string, part int, shard string")
    got = sharding.shard(docs.repartition(7), shards=8).toPandas()
    assert len(got) == len(rows) and set(got.shard) <= set(range(8))
    text = {(-1 if d is None else d): t or "" for d, t in rows}
    got["text"] = [text[-1 if np.isnan(d) else int(d)] for d in got.doc_id.astype(float)]
    assert (got.groupby("text").shard.nunique() == 1).all()
    assert got["size"].tolist() == [len(t) + 16 for t in got.text]
    assert got.text_crc32.tolist() == [zlib.crc32(t.encode()) for t in got.text]
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    sums = got.groupby("shard")["size"].sum().sort_values()
    hot = got[got.text == "hot " * 20].shard.iloc[0]
    rest = sums.drop(hot)
    assert rest.max() - rest.min() <= 450


def test_shards_by_capacity_and_empty(spark):
    docs = spark.createDataFrame([(i, "y" * 84 + str(i)) for i in range(10, 20)],
                                 "doc_id long, text string")
    got = sharding.shard(docs, capacity=250).toPandas()
    assert got.groupby("shard")["size"].sum().max() <= 250 and got.shard.nunique() == 5
    assert sharding.shard(docs.limit(0), shards=4).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(docs)
