"""One id that holds most rows: what reaches the driver stays bounded."""

from pyspark.sql import functions as F

from canopy.llm import decontaminate, quality


def test_quality_sample_with_a_hot_id(spark, monkeypatch):
    rows = [(0, f"text {i} of the same id") for i in range(1500)] + [(0, "copy")] * 1500
    rows += [(i, f"other {i}") for i in range(1, 10)] + [(None, "no id"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, quality int")
    sizes = []
    # takes the whole sample before anything is fitted
    monkeypatch.setattr(quality, "estimated_prior", lambda p, u: sizes.append((len(p), len(u)))
                        or 0.5)
    quality.train(docs, labels, F.lit(True), positives=60, unlabelled=60)
    quality.train(docs, labels, F.lit(True), positives=5000, unlabelled=5000)
    assert 20 < sizes[0][0] < 120 and 20 < sizes[0][1] < 120
    # each (id, text) once: 1,500 texts and the copy, nine others, a null text; and no id
    assert sizes[1] == (1511, 1512)


def test_benchmark_blocks_with_a_hot_item(spark):
    rows = [("hot", f"words of text number {i} here") for i in range(400)]
    rows += [(f"i{i}", f"item {i}") for i in range(20)]
    items = spark.createDataFrame(rows, "item_id string, text string")
    blocks = list(decontaminate._blocks(items, 500))
    assert len(blocks) > 5
    assert sorted((r.item_id, r.text) for b in blocks for r in b.itertuples()) == sorted(rows)
    assert max(b["text"].str.split().str.len().sum() for b in blocks) < 1000
    docs = spark.createDataFrame([(1, "say words of text number 7 here and words of text "
                                   "number 399 here"), (2, "words of")],
                                 "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, items).collect()}
    few = {r.doc_id: r for r in _with_blocks(docs, items, 500)}
    assert got[1].contaminated and got[1].n_items == 1 and not got[2].contaminated
    assert few == got


def _with_blocks(docs, items, block_words):
    find = decontaminate.find_matches
    try:
        decontaminate.find_matches = lambda d, b, width: find(d, b, width,
                                                              block_words=block_words)
        return decontaminate.decontaminate(docs, items).collect()
    finally:
        decontaminate.find_matches = find
