"""op3_lm_scoring: every count takes part, however rare the string in however large a corpus."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from canopy.llm import ppm

from .test_ppm import brute_counts, brute_log10

MANY = "The cat sat on the mat, the dog sat on the log. "
RARE = ["Quartz jumps over a vexed wizard", "thé vexed dog", None, ""]
ASKED = ["vexed wizard", "quartz on the mat", "zzz", "the cat"]


def counts_of(texts, order):
    counts = defaultdict(Counter)
    for text, times in texts:
        for context, node in brute_counts([text], order).items():
            for symbol, n in node.items():
                counts[context][symbol] += n * times
    return counts


def check(spark, texts, order):
    learn = [(t, True) for t, times in texts for _ in range(times)]
    docs = spark.createDataFrame(
        [(i, t, x) for i, (t, x) in enumerate(learn + [(t, False) for t in ASKED])],
        "doc_id long, text string, learn boolean").repartition(4)
    got = {r.doc_id: r.score for r in ppm.score(docs, F.col("doc_id") < len(learn), order)
           .collect()}
    assert len(got) == len(learn) + len(ASKED)
    counts = counts_of(texts, order)
    want = {t: brute_log10(t, counts, order, 1) for t in [t for t, _ in texts] + ASKED}
    for i, (text, _) in enumerate(learn + [(t, False) for t in ASKED]):
        assert got[i] == pytest.approx(want[text], rel=1e-9), text


def test_rare_strings_count_in_a_large_corpus(spark):
    # over 2**21 positions, where strings seen once used to be dropped
    check(spark, [(MANY * 400, 120), *((t, 1) for t in RARE)], 6)


@pytest.mark.parametrize("order", [6, 4, 3, 2, 1])
@pytest.mark.parametrize("chunk,shard,hot", [(32_000_000, 1 << 23, 1 / 256), (60, 10, 0.02),
                                             (1, 40, 0.001)])
def test_chunks_shards_and_hot_contexts_change_no_score(spark, monkeypatch, order, chunk, shard,
                                                        hot):
    monkeypatch.setattr(ppm, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(ppm, "SHARD_POSITIONS", shard)
    monkeypatch.setattr(ppm, "HOT_SHARE", hot)
    check(spark, [(MANY, 3), *((t, 1) for t in RARE)], order)


@pytest.mark.parametrize("known", [[], [b"\xff" * 6 + b"a"]])
def test_a_scan_that_changes_between_its_reads_is_an_error(known):
    import numpy as np
    import pyarrow as pa

    grams = np.sort(ppm._turned(np.asarray([int.from_bytes(x, "big") for x in known], np.uint64)))
    answers = pa.table({"grams": pa.array([ppm._packed(grams)], pa.binary()),
                        "log10": pa.array([np.zeros(len(known)).tobytes()], pa.binary())})
    with pytest.raises(RuntimeError, match="other rows"):
        ppm._chunk_scores(pa.array(["abc"], pa.large_string()), answers, 6)
