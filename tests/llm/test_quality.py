from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallymart.llm import quality
from tests.llm.conftest import prose


def test_held_out_accuracy(spark):
    docs = [(i, prose(i, 80) if i % 4 else " ".join(w + "!!" for w in prose(i, 80).upper().split()), int(i % 4 > 0)) for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, quality int")
    held = quality.fold(F.col("doc_id"), 5) == 0
    model = quality.train(frame, frame.where(~held), fit_rows=100, curve_rows=100)
    rows = quality.with_score(frame.where(held), model).collect()
    assert len(rows) > 50
    assert np.mean([(r["score"] >= 0.3) == (r["quality"] == 1) for r in rows]) >= 0.98


def test_a_feature_of_one_class_decides():
    texts = pa.array(["good words here", "bad words here"] * 20)
    rows, marks = list(quality.indicators(texts)), np.array([1, 0] * 20)
    counts = np.zeros((2, quality.DIMS))
    for cells, m in zip(rows, marks, strict=True):
        counts[m, cells] += 1
    scale = quality.log_count_ratio(counts[1], counts[0])
    weights = quality.dual_coordinate_descent(rows, marks, scale) * scale
    margins = [quality.margin(weights, c) for c in rows]
    assert min(margins[::2]) > 0.9 and max(margins[1::2]) < -0.9


def test_dual_coordinate_descent_meets_its_conditions():
    """At the optimum a row with slack has no weight and a row inside the margin has the most."""
    draw = np.random.default_rng(1)
    rows = [np.sort(draw.choice(50, 8, replace=False)) for _ in range(60)]
    marks = np.array([int(r[:4].sum() % 3 == 0) for r in rows])
    scale = draw.normal(size=quality.DIMS)
    weights = quality.dual_coordinate_descent(rows, marks, scale, epochs=3000, tolerance=1e-8)
    y = np.where(marks > 0, 1, -1)
    cost = [len(y) / (2 * (y == s).sum()) for s in y]

    def loss(w):
        x = np.array([(w[r] * scale[r]).sum() / np.sqrt(8) for r in rows])
        return 0.5 * w @ w + (np.array(cost) * np.maximum(0, 1 - y * x)).sum()

    best = loss(weights)
    for _ in range(200):
        assert loss(weights + 1e-3 * draw.normal(size=quality.DIMS) * (weights != 0)) >= best - 1e-9


def test_indicators_are_sets_of_the_whole_text():
    one, two = quality.indicators(pa.array(["ab ab", "ab ab ab ab"]))
    assert len(one) == len(set(one.tolist())) and set(one) <= set(two)
    alone = [c.tolist() for c in quality.indicators(pa.array([None, "", "x" * 3_000_000, "ab ab"]))]
    assert alone[0] == alone[1] == [] and alone[3] == one.tolist()


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(None, 0), (2, 7), (3, None), (4, 0), (4, 1)]])
def test_few_or_odd_labels(spark, odd, labels):
    model = quality.train(odd, spark.createDataFrame(labels, "doc_id long, quality int"))
    scores = [r["score"] for r in quality.with_score(odd, model).collect()]
    assert len(scores) == 13 and all(0 <= s <= 1 for s in scores)


def test_odd_rows(spark, odd, clashing, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (7, 0), (8, 0), (99, 0)], "doc_id long, quality int")
    model = quality.train(clashing, labels)
    scored = quality.with_score(clashing, model, name="fresh")
    assert scored.columns == [*clashing.columns, "fresh"]
    by_text = {r["text"]: r["fresh"] for r in scored.collect()}
    assert by_text[None] == by_text[""]
    assert quality.with_score(nothing, model).collect() == []
    assert quality.train(nothing, labels).slope == 0.0
