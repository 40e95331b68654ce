import zlib

import numpy as np

from stationgrid.llm import queries, quality


def test_held_out_accuracy(spark, sf):
    got = {r.doc_id: r for r in queries.op2_quality_classifier(spark, sf).collect()}
    assert len(got) == 200 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert np.mean([got[r.doc_id].predicted == r.quality for r in labels]) >= 0.95


def test_batched_scores_equal_plain_mean():
    settings = quality.Settings(buckets=64, dim=4, steps=50)
    rows = [(*quality.document_features(t, settings), y) for t, y in (("good plain words here", 1), ("bad bad bad bad", 0))]
    model = quality.fit(rows, settings)
    for text in ("good words", "bad bad", "", "a " * 500, "x" * 10_000):
        keys, shares = quality.document_features(text, settings)
        z = model.bias + float(model.scores[keys] @ shares)
        assert np.isclose(quality.probabilities([text], quality.WordScores(model))[0], 1 / (1 + np.exp(-z)), atol=1e-5)


def test_held_out_labels_teach_nothing(spark, documents, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(documents, labels, 50), quality.train(documents, turned, 50)
    assert np.array_equal(a.scores, b.scores) and a.bias == b.bias


def test_odd_rows_and_labels(spark, odd, table):
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (6, 0, 0), (None, 1, 0), (5, None, 0), (2, 7, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(odd, labels).collect()
    assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
    assert [r.score for r in quality.classify(odd, labels.limit(0)).collect()] == [0.5] * 8
    assert quality.classify(table([]), labels).collect() == []
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns and kept.count() <= 8


def test_middles_of_long_runs_count(monkeypatch):
    """Text without spaces is read whole, whatever the blocks it is hashed in."""
    settings = quality.Settings(buckets=1 << 16, dim=4, steps=400)
    edges = "春夏秋冬" * 10
    good, bad = (edges + middle * 40 + edges for middle in ("山川草木", "雨雪風雲"))
    whole = [quality.document_features(t, settings) for t in (good, bad)]
    assert len(np.setxor1d(whole[0][0], whole[1][0])) > 10
    rows = [(*f, y) for f, y in zip(whole, (1, 0))]
    model = quality.fit(rows, settings)
    a, b = quality.probabilities([good, bad], quality.WordScores(model))
    assert a > 0.5 > b
    monkeypatch.setattr(quality, "BLOCK_BYTES", 7)
    for text, (keys, shares) in zip((good, bad), whole):
        again = quality.document_features(text, settings)
        assert np.array_equal(again[0], keys) and np.allclose(again[1], shares)
    assert np.allclose(quality.probabilities([good, bad], quality.WordScores(model)), (a, b))
