"""The factorisation machine: its scoring identity, held-out accuracy and odd rows."""

import numpy as np
from pyspark.sql import types as T

from vectile.llm.machine import Rows, BINS, STATISTICS, WORD_BUCKETS, Machine, fit_quality, predict_quality, train, words_and_statistics

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType()), T.StructField("label", T.StringType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType())])


def test_linear_time_score_equals_all_pairs():
    draw = np.random.default_rng(1)
    size = WORD_BUCKETS + len(STATISTICS) * BINS
    machine = Machine(np.sort(draw.random((len(STATISTICS), BINS - 1))), 0.3, draw.normal(size=size), draw.normal(size=(size, 4)))
    index, value = machine.features(*words_and_statistics("The cat | sat\non the mat. THE end #1"))
    pairs = sum(machine.factor[i] @ machine.factor[j] * value[a] * value[b] for a, i in enumerate(index) for b, j in enumerate(index) if a < b)
    want = 1 / (1 + np.exp(-(machine.bias + machine.weight[index] @ value + pairs)))
    assert abs(machine.score(index, value) - want) < 1e-9


def test_pairs_are_learned():
    draw = np.random.default_rng(2)
    rows, labels = [], []
    for _ in range(600):
        a, b = draw.integers(0, 2, 2)
        rows.append((np.array([10 + a, 20 + b]), np.array([1.0, 1.0]), np.zeros(len(STATISTICS))))
        labels.append(float(a == b))
    machine = train(Rows.of(rows), np.array(labels), epochs=60)
    got = [machine.score(*machine.features(*r)) > 0.5 for r in rows]
    assert np.mean(np.array(got) == np.array(labels)) > 0.95


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = predict_quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert len(bad) > 50
    kept, caught = np.mean([r.predicted for r in good]), np.mean([1 - r.predicted for r in bad])
    print("good kept", kept, "bad caught", caught)
    assert kept >= 0.99 and caught >= 0.95


def test_odd_rows(spark):
    rows = [(1, None, "a", "b"), (2, "", None, None), (3, " \n\t", None, None), (None, "one two", None, None), (4, "x", None, None), (4, "x", None, None), (5, "long words " * 200_000, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0), (4, 1), (None, 1), (5, None), (99, 0), (6, 5)], LABELS)
    found = predict_quality(docs, labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    assert predict_quality(docs, labels).collect() == found
    assert {r.score for r in predict_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert predict_quality(docs.limit(0), labels).collect() == []
    only = fit_quality(docs, spark.createDataFrame([(i, 1) for i in range(9)], LABELS))
    assert only.score(*only.features(*words_and_statistics("any text"))) > 0.9
