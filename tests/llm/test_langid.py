import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from canopy.llm import langid, queries
from canopy.llm.common import strings, text_pieces

SF = "/root/testdata/sf0.01"


def brute_path(scores, penalty):
    best = None
    for path in itertools.product(range(scores.shape[1]), repeat=len(scores)):
        value = sum(scores[t, s] for t, s in enumerate(path)) \
            - penalty * sum(a != b for a, b in zip(path, path[1:]))
        if best is None or value > best:
            best = value
    return best


def test_viterbi_is_optimal_on_short_texts():
    rng = np.random.default_rng(3)
    sizes = [1, 5, 0, 7, 3]
    scores = rng.normal(size=(sum(sizes), 3)).astype(np.float32) * 3
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    path = langid.viterbi(scores, bounds, 2.0)
    for a, b in zip(bounds, bounds[1:]):
        if b > a:
            own = path[a:b]
            value = sum(scores[a + t, s] for t, s in enumerate(own)) \
                - 2.0 * (np.diff(own) != 0).sum()
            assert value == pytest.approx(brute_path(scores[a:b], 2.0), abs=1e-4)


def test_viterbi_across_blocks():
    rng = np.random.default_rng(4)
    scores = rng.normal(size=(700, 4)).astype(np.float32)
    path = langid.viterbi(scores, np.asarray([0, 0, 300, 700]), 3.0)
    for a, b in ((0, 300), (300, 700)):
        value = np.zeros(4)
        for t in range(a, b):  # plain forward pass
            value = np.maximum(value, value.max() - 3.0 * (t > a)) + scores[t] if t > a \
                else scores[t].astype(float)
        own = path[a:b]
        got = scores[np.arange(a, b), own].sum() - 3.0 * (np.diff(own) != 0).sum()
        assert got == pytest.approx(value.max(), abs=1e-2)


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t, l) for i, (t, l) in enumerate([
        ("the quick brown fox jumps over the lazy dog and runs with the other foxes", "en"),
        ("der schnelle braune fuchs springt über den faulen hund und läuft weiter", "de"),
        ("быстрая коричневая лиса прыгает через ленивую собаку и бежит дальше", "ru")] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return langid.train(docs, F.lit(True))


def test_spans_of_mixed_text(spark, model):
    one = "the quick dog jumps over the other lazy foxes and runs"
    two = "быстрая собака бежит через дальше"
    three = "der faule hund springt über den braunen fuchs und läuft"
    docs = spark.createDataFrame([(1, f"{one}. {two}. {three}")],
                                 "doc_id long, text string")
    row = langid.label(docs, model).first()
    text = docs.first().text
    assert [s.lang for s in row.spans] == ["en", "ru", "de"]
    assert [text[s.start:s.end] for s in row.spans] == [one, two, three]


@pytest.fixture(scope="module")
def with_chinese(spark):
    rows = [(i, t, l) for i, (t, l) in enumerate([
        ("the quick brown fox jumps over the lazy dog and runs with the other foxes", "en"),
        ("敏捷的棕色狐狸跳过了懒狗然后和其他狐狸一起跑开我们今天去学校学习中文", "zh"),
        ("すばやい茶色の狐はのろまな犬を飛び越えて他の狐と一緒に走ります日本語", "ja")] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return langid.train(docs, F.lit(True))


@pytest.mark.parametrize("clause,lang", [
    ("狐狸跳过了懒狗然后和其他狐狸一起跑开我们今天去学校学习中文狐狸跳过了", "zh"),
    ("のろまな犬を飛び越えて他の狐と一緒に走ります", "ja"), ("学校学习", "zh")])
def test_an_unspaced_clause_is_a_span_of_its_own(spark, with_chinese, clause, lang):
    before, after = "the lazy dog runs over the fox ", " and the other foxes jump"
    docs = spark.createDataFrame([(1, before + clause + after)], "doc_id long, text string")
    row = langid.label(docs, with_chinese).first()
    assert [(s.start, s.end, s.lang) for s in row.spans] == [
        (0, len(before) - 1, "en"), (len(before), len(before + clause), lang),
        (len(before + clause) + 1, len(before + clause + after), "en")]
    assert row.lang_pred == "en" and row.score < 1


def test_pieces_change_no_result(spark, model, monkeypatch):
    rng = np.random.default_rng(1)
    words = ["the", "lazy", "dog", "der", "faule", "hund", "собака", "бежит", "12", "fox,"]
    texts = [" ".join(rng.choice(words, n)) for n in (3, 200, 1, 900, 40)] + [None, "", "the dog"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    whole = sorted(map(str, langid.label(docs, model).collect()))
    got = []
    for limit in (64, 500):
        # labelled here, as the limit cannot be set in the workers
        batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts))),
                                            "text": pa.array(texts, pa.string())})
        monkeypatch.setattr(langid, "text_pieces", lambda t, _, n=limit: text_pieces(t, n))
        out = labelled_here(spark, model, batch, monkeypatch)
        got.append(out)
    assert got[0] == got[1] == [
        (r.lang_pred, round(r.score, 9), [tuple(s) for s in r.spans])
        for r in sorted(langid.label(docs, model).collect(), key=lambda r: r.doc_id)]
    assert len(whole) == len(texts)


def labelled_here(spark, model, batch, monkeypatch):
    """``label`` on one batch in this process."""
    caught = {}

    class Rows:
        schema = {"doc_id": type("f", (), {"dataType": type("t", (), {
            "simpleString": staticmethod(lambda: "long")})})}

        def mapInArrow(self, run, _):
            caught["out"] = list(run([batch]))

    class Docs:
        sparkSession = spark

        def select(self, *_):
            return Rows()

    langid.label(Docs(), model)
    return [(r["lang_pred"], round(r["score"], 9),
             [(s["start"], s["end"], s["lang"]) for s in r["spans"]])
            for b in caught["out"] for r in b.to_pylist()]


def test_labels_equal_a_plain_search(spark, model):
    """Words and scores by hand, best path by trying all, then the rule for the text."""
    texts = ["the dog der hund", "собака the", "fox jumps über faulen, der dog", "a", "der the der"]
    got = {r.doc_id: r for r in langid.label(spark.createDataFrame(
        list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    column = {c: k for k, c in enumerate(model.languages)}
    for i, text in enumerate(texts):
        words = [w.strip(",") for w in text.lower().split()]
        scores = np.zeros((len(words), len(column)))
        for t, word in enumerate(words):
            own = langid._Letters(strings(pa.array([word])))
            raw = model.weights[own.bucket].sum(0)
            script = model.allowed[own.kind[0]]
            for k in range(len(column)):
                scores[t, k] = max(-12.0, raw[k] - raw[script].max()) if script[k] else -1e4
        paths = sorted(itertools.product(range(len(column)), repeat=len(words)), key=lambda p: (
            -(sum(scores[t, k] for t, k in enumerate(p))
              - 8.0 * sum(a != b for a, b in zip(p, p[1:])))))
        letters = [sum(len(w) for w, k in zip(words, paths[0]) if k == lang)
                   for lang in range(len(column))]
        best = max(range(len(column)), key=lambda k: letters[k])
        runs = [k for k, _ in itertools.groupby(paths[0])]
        if len(runs) > 2 and runs[0] == runs[-1] and letters[runs[0]] >= 0.2 * sum(letters):
            best = runs[0]
        assert [s.lang for s in got[i].spans] == [model.languages[k] for k in runs]
        assert got[i].lang_pred == model.languages[best]
        assert got[i].score == pytest.approx(letters[best] / sum(letters))


def test_edge_rows(spark, model):
    rows = [(1, None, 5), (2, "", 5), (3, "12 !? 34", 5), (None, "the dog", 5), (4, "the dog", 5),
            (4, "the dog", 5), (5, "the lazy dog " * 40_000, 5), (6, "漢字", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = langid.label(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in (1, 2, 3):
            assert (r.lang_pred, r.score, r.spans) == ("und", 0.0, [])
        elif r.doc_id != 6:
            assert r.lang_pred == "en" and 0 < r.score <= 1
    assert langid.label(docs.limit(0), model).count() == 0


def test_nothing_learned(spark, model):
    docs = spark.createDataFrame([(1, "the dog", None)], "doc_id long, text string, lang string")
    none = langid.train(docs, F.lit(True))
    assert langid.label(docs, none).first()[1] == "und"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.op1_language_id(spark, SF).join(docs, "doc_id").filter("held_out")
    n, right = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))
                       ).first()
    assert right / n >= 0.97
