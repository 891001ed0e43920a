"""Defined cases of the corpus pipeline's stages and clashing column names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from canopy.llm import line_dedup, quality, simhash

SF = "/root/testdata/sf0.001"
CLASHES = ["score", "predicted", "n_lines", "n_removed", "fp", "root", "component_id", "m_id",
           "text_hash", "b_id", "row", "number", "ids", "loose", "group"]


def rows():
    lines = "one line of it\nsecond line\nthird line"
    return [(1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "word", None, None, 4),
            (None, "a text without an id", "en", "s", 20), (None, "a text without an id", "en",
                                                            "s", 20),
            (4, f"{lines}\nown ending", "en", "s", 50), (5, f"{lines}\nother ending", "en", "s", 50),
            (6, "same id", "en", "s", 7), (6, "same id", "en", "s", 7), (6, "another", "en", "t", 7),
            (7, "long text of many words " * 60_000, "en", "s", 1),
            (8, "\u6f22\u5b57 \U0001f600", "zh", "s", 4)]


def frame(spark, data):
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, "
                                       "n_chars long")
    return docs.withColumns({c: F.lit(7) for c in CLASHES})


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_every_stage_takes_odd_rows_clashing_names_and_empty_tables(spark, name, stage):
    docs = frame(spark, rows())
    got = stage(spark, docs, SF).collect()
    last = name == P.STAGES[-1][0]
    none = stage(spark, docs.limit(0), SF)
    assert none.count() == 0
    if last:
        assert {r.doc_id for r in got} == {r[0] for r in rows()}
        assert sum(r.length for r in got if r.doc_id == 2) == 1
        return
    assert none.columns == P.COLUMNS
    assert all(r.asDict().keys() == set(P.COLUMNS) for r in got)
    ids = sorted(str(r.doc_id) for r in got)
    if name == "line_dedup":
        assert len(got) == len(rows())
        assert {r.doc_id: r.text for r in got if r.doc_id in (1, 4, 5)} == {
            1: None, 4: rows()[5][1], 5: "other ending"}
        assert [r.n_chars for r in got if r.doc_id == 5] == [len("other ending")]
    elif name == "simhash_neardup":
        # null and empty are one group; equal rows are one; a null id is the largest
        assert ids.count("6") == 2 and ids.count("None") == 1 and "1" in ids and "2" not in ids
    elif name == "decontamination":
        assert len(got) == len(rows())


def test_the_chosen_row_does_not_depend_on_chance(spark):
    text = " ".join(f"w{i}" for i in range(200))
    data = [(1, text + f" x{i}", "en", f"s{i % 3}", i) for i in range(30)] + [
        (9, text, "en", "s", 1)]
    for parts in (1, 5, 9):
        got = simhash.one_of_each(frame(spark, data).repartition(parts)).collect()
        assert [(r.doc_id, r.text) for r in got] == [(1, min(t for _, t, *_ in data[:30]))]


def test_operators_replace_or_keep_clashing_columns(spark):
    docs = frame(spark, rows())
    assert line_dedup.remove_repeats(docs).filter("doc_id = 4").first().n_lines == 4
    assert simhash.one_of_each(docs).columns == docs.columns
    nothing = np.zeros((0, quality._width()))
    scorer = quality.fit(nothing, nothing, 0.5)
    out = quality.score(docs, scorer, keep=docs.columns)
    assert out.columns.count("score") == 1 and {r.score for r in out.collect()} == {0.5}


def test_whole_run_keeps_or_drops_each_document_once(spark):
    pieces = P.run(spark, SF)
    ids = {r.doc_id for r in pieces.select("doc_id").distinct().collect()}
    docs = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert ids <= docs and len(ids) > len(docs) / 3


def joins(df):
    """The join operators of the plan that ``df`` starts with."""
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n")
            if "Join" in x]


def test_near_duplicates_beyond_the_limits_are_joined_by_shuffle(spark, monkeypatch):
    docs = frame(spark, rows())
    want = sorted(map(str, simhash.one_of_each(docs).collect()))
    monkeypatch.setattr(simhash, "BROADCAST_IDS", -1)
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", -1)
    found, real = [], simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda df, x: found.extend(joins(df)) or real(df, x))
    got = simhash.one_of_each(docs)
    assert sorted(map(str, got.collect())) == want
    found += joins(got)
    assert found and not [x for x in found if "Broadcast" in x]


def test_tables_as_large_as_the_corpus_are_not_broadcast_by_estimate(spark, monkeypatch):
    # Spark's estimates of these few rows would broadcast any table
    docs = frame(spark, [(i, " ".join(f"w{k}" for k in range(i % 3, 30)), "en", "s", 1)
                         for i in range(12)])
    found, real = [], P.stored
    monkeypatch.setattr(P, "stored", lambda df, x: found.extend(joins(df)) or real(df, x))
    tables = {"benchmark": spark.createDataFrame(
        [("a", " ".join(f"w{k}" for k in range(10)))], "item_id string, text string")}
    monkeypatch.setattr(P, "read_table", lambda spark, sf_dir, name: tables[name])
    kept = P.decontamination_stage(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == [i for i in range(12) if i % 3]
    counts = [x for x in found if "h_doc" in x]
    assert counts and not [x for x in counts if "Broadcast" in x]
    candidates = [x for x in found if "c_doc" in x and "Broadcast" in x]
    assert candidates and all("LeftSemi" in x for x in candidates)
    lines = joins(line_dedup.remove_repeats(docs))
    assert [x for x in lines if "SortMergeJoin [k1" in x]
