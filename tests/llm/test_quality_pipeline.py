import hashlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from canopy.llm import quality, queries
from canopy.llm.common import id_remainder, strings
from tools.check_oracle import TABLES, digest

from .brute import components, contamination, fingerprint
from .brute import line_dedup as brute_lines

SF, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_risk_separates_with_positives_and_mixture():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1.5, 1, (600, 5)), rng.normal(-1.5, 1, (200, 5))
    scorer = quality.fit(rng.normal(1.5, 1, (600, 5)), np.concatenate([good, bad]), 0.75)
    assert (scorer.score(good) > 0.5).mean() > 0.9
    assert (scorer.score(bad) < 0.5).mean() > 0.8


def plain_figures(text):
    """Words, repeats of the word before, distinct words and byte classes, one by one."""
    data = (text or "").encode()
    space = b" \t\n\v\f\r"
    words = bytes(32 if c in space else c + 32 if 65 <= c <= 90 else c for c in data).split()
    return (len(data), len(words), sum(a == b for a, b in zip(words, words[1:])),
            len(set(words)), sum(c in space for c in data), sum(48 <= c <= 57 for c in data),
            sum(65 <= c <= 90 for c in data), sum(c >= 128 for c in data))


TEXTS = [" ".join(f"w{i % 900}" for i in range(5000)), "", None, "A!! A!! B!! é1", "a a\na  b",
         "one " * 400 + "TWO two", "x" * 700, " lead and trail "]


def test_figures_equal_a_plain_count():
    sums, _ = quality._sums(strings(pa.array(TEXTS)))
    for text, row in zip(TEXTS, sums):
        got = (row[0], row[8], row[9], row[10], row[1], row[2], row[3], row[5])
        assert got == plain_figures(text)


@pytest.mark.parametrize("size", [40, 333, 5000])
def test_features_do_not_depend_on_pieces(monkeypatch, size):
    texts = strings(pa.array(TEXTS))
    whole = quality.features(texts)
    assert np.isfinite(whole).all() and (whole[1] == whole[2]).all()
    monkeypatch.setattr(quality, "PIECE_BYTES", size)
    assert np.array_equal(quality.features(texts), whole)


def test_gradient_of_the_risk():
    """Steps of the fit follow the risk's numerical gradient, also where the negative part is
    below zero."""
    rng = np.random.default_rng(5)
    p, u = rng.normal(0.5, 1, (40, 3)), rng.normal(-0.5, 1, (60, 3))
    mean, scale = u.mean(0), u.std(0) + 1e-3
    xp, xu = (p - mean) / scale, (u - mean) / scale

    def parts(w, prior):
        zp, zu = xp @ w[:-1] + w[-1], xu @ w[:-1] + w[-1]
        positive = prior * np.logaddexp(0, -zp).mean()
        return positive, np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()

    for prior in (0.2, 0.95):
        w = np.zeros(4)
        direction = np.zeros(4)
        for k in range(4):
            step = np.zeros(4)
            step[k] = 1e-6
            a, b = parts(w + step, prior), parts(w - step, prior)
            down, up = (a[0] - b[0]) / 2e-6, (a[1] - b[1]) / 2e-6
            direction[k] = down + up if parts(w, prior)[1] >= 0 else -up
        first = quality.fit(p, u, prior, steps=1)
        got = np.append(first.weights, first.bias)
        # Adam's first step is the rate against the gradient's sign
        assert np.allclose(got, -0.03 * np.sign(direction), atol=1e-5)


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.8])
def test_prior_from_positives_and_unlabelled(prior):
    rng = np.random.default_rng(7)
    positive = rng.normal(3, 1, 8000)
    n = int(8000 * prior)
    unlabelled = np.concatenate([rng.normal(3, 1, n), rng.normal(-3, 1, 8000 - n)])
    assert quality.class_prior(positive, unlabelled) == pytest.approx(prior, abs=0.04)
    assert quality.class_prior(positive[:0], unlabelled) == 0.5


def test_estimated_prior_needs_no_negative_labels():
    rng = np.random.default_rng(8)
    for prior in (0.3, 0.8):
        n = int(3000 * prior)
        web = np.concatenate([rng.normal(1.5, 1, (n, 4)), rng.normal(-1.5, 1, (3000 - n, 4))])
        got = quality.estimated_prior(rng.normal(1.5, 1, (2000, 4)), rng.permutation(web))
        assert got == pytest.approx(prior, abs=0.06)


def test_negative_labels_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    where = id_remainder("doc_id", 5) != 0
    a, b = (quality.train(docs, x, where) for x in (labels, labels.filter("quality = 1")))
    assert np.allclose(a.weights, b.weights) and a.bias == pytest.approx(b.bias)


def test_held_out_separation(spark):
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    got = queries.op9_quality_classifier(spark, SF01).join(labels, "doc_id").filter(
        "held_out").toPandas()
    right = (got.predicted == got.quality).mean()
    assert right > 0.9
    assert got.score.between(0, 1).all()
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    where = id_remainder("doc_id", 5) != 0
    flipped = labels.withColumn("quality", F.when(where, F.col("quality")).otherwise(
        1 - F.col("quality")))
    a, b = (quality.train(docs, x, where) for x in (labels, flipped))
    assert np.allclose(a.weights, b.weights) and a.bias == pytest.approx(b.bias)


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 2.0), (2, "", 2.0), (None, "a text", 2.0),
                                  (3, "b", 2.0), (3, "b", 2.0)],
                                 "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (3, 0)],
                                   "doc_id long, quality int")
    scorer = quality.train(docs, labels, F.lit(True))
    assert quality.score(docs, scorer).count() == 5
    none = quality.train(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.limit(0), scorer).count() == 0
    assert quality.train(docs.limit(0), labels, F.lit(True)) is not None


@pytest.mark.parametrize("name", ["op2_decontamination", "op5_nearest_neighbours",
                                  "op6_line_dedup"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = E.queries()[name](spark, SF).toPandas(), con.execute(E.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert digest(got)[0] == digest(want)[0]


def test_contract_columns(spark):
    want = {
        "op1": ["doc_id", "held_out", "lang_pred", "score"],
        "op2": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        "op3": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score",
                "score"],
        "op4": ["doc_id", "fingerprint", "component_id"],
        "op5": ["query_id", "rank", "vec_id", "score"],
        "op7": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
        "op8": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        "op9": ["doc_id", "held_out", "score", "predicted"],
        "op10": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    }
    for prefix, columns in want.items():
        name = next(x for x in E.queries() if x.startswith(prefix + "_"))
        assert E.queries()[name](spark, SF).columns[:len(columns)] == columns


def test_stages(spark):
    """Every stage against its plain version, on the rows the one before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    frames = []
    for _, stage in corpus_pipeline.STAGES:
        frames.append([tuple(r) for r in stage(spark, docs, SF).collect()])
        if len(frames) < len(corpus_pipeline.STAGES):
            docs = spark.createDataFrame(frames[-1], docs.schema)
    accepted, lines, single, clean, pieces = frames

    scorer = quality.train(spark.read.parquet(f"{SF}/documents.parquet"),
                           spark.read.parquet(f"{SF}/labels.parquet"),
                           id_remainder("doc_id", 5) != 0)
    score = scorer.score(quality.features(strings(pa.array([r.text for r in rows]))))
    assert sorted(accepted) == sorted(tuple(r) for r, s in zip(rows, score) if s >= 0.3)

    hashes = dict(spark.createDataFrame([(r[1],) for r in accepted], "t string").select(
        "t", F.xxhash64("t")).collect())
    cleaned = brute_lines([(r[0], r[1]) for r in accepted], hashes)
    assert sorted((r[0], r[1]) for r in lines) == sorted(
        (r[0], t) for r, t in zip(accepted, cleaned))

    fp = {r[0]: fingerprint(r[1]) for r in lines}
    root = components(fp.values())
    first = {}
    for doc in sorted(fp):
        first.setdefault(root[int(np.uint64(fp[doc]).astype(np.int64))], doc)
    assert sorted(r[0] for r in single) == sorted(first.values())

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select(
        "item_id", "text").collect()]
    dirty = {r[0] for r in single if contamination(r[1], items)[1]}
    assert sorted(r[0] for r in clean) == sorted(r[0] for r in single if r[0] not in dirty)
    assert {p[0] for p in pieces} == {r[0] for r in clean}


def test_digest_of_items(spark):
    row = queries.op2_decontamination(spark, SF).filter("n_items = 0").first()
    assert row.items_sha256 == hashlib.sha256(b"").hexdigest()
