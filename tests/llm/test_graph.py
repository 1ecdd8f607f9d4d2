from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymart.llm import graph
from tests.llm.conftest import FOLDER


def exact(rows, queries, k):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], dtype=float)
    found = {}
    for own, vector in queries:
        s = x @ np.array(vector, dtype=float)
        order = [int(i) for i in np.lexsort((ids, -s)) if ids[i] != own][:k]
        found[own] = [(int(ids[i]), float(s[i])) for i in order]
    return found


def lists(df):
    found: dict = {}
    for r in df.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return found


@pytest.mark.parametrize("shard_rows", [100, 5000])
def test_recall(spark, shard_rows):
    vectors = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding")
    asked = vectors.where("vec_id % 20 = 0")
    rows = [tuple(r) for r in vectors.collect()]
    best = exact(rows, [tuple(r) for r in asked.collect()], 20)
    got = lists(graph.nearest(vectors, asked, shard_rows=shard_rows))
    assert got.keys() == best.keys() and all(len(v) == 20 for v in got.values())
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in best[q]}) for q in best)
    assert hit / (20 * len(best)) >= 0.95
    truth = {(q, r[0]): float(np.dot(np.array(r[1], dtype=float), np.array(dict(rows)[q], dtype=float))) for q in list(best)[:3] for r in rows}
    for q in list(best)[:3]:
        assert all(s == pytest.approx(truth[q, i], abs=1e-12) for i, s in got[q])


def hit_share(spark, x, shard_rows, asked=150):
    """Recall of 20 by score against all rows, for the first queries."""
    import pyarrow as pa

    flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
    frame = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(len(x))), "embedding": flat}))
    got = lists(graph.nearest(frame, frame.where(F.col("vec_id") < asked), shard_rows=shard_rows))
    hits = 0
    for q in range(asked):
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len({i for i, _ in got[q]} & set(np.argsort(-scores)[:20].tolist()))
    return hits / (20 * asked)


@pytest.mark.parametrize("shard_rows", [1024, 4096])
@pytest.mark.parametrize("norms", ["unit", "gaussian", "log-normal", "two sizes"])
def test_recall_whatever_the_norms(spark, norms, shard_rows):
    draw = np.random.default_rng(11)
    x = draw.normal(size=(4096, 64))
    if norms != "gaussian":
        x /= np.sqrt((x**2).sum(axis=1, keepdims=True))
    if norms == "log-normal":
        x *= draw.lognormal(0, 1, size=(4096, 1))
    if norms == "two sizes":
        x[::2] *= 100.0
    assert hit_share(spark, x, shard_rows) >= 0.9


def test_layers_hold_all_nodes_once():
    draw = np.random.default_rng(3)
    for norms in (np.ones(500), draw.lognormal(0, 1, 500), np.array([5.0]), np.arange(1, 66) * 1.0):
        found = graph.layers(norms)
        assert sorted(np.concatenate(found).tolist()) == list(range(len(norms)))
        assert all(norms[a].min() >= norms[b].max() for a, b in zip(found, found[1:]))
        assert all(norms[m].max() <= graph.RATIO * norms[m].min() or len(m) < 2 * graph.LEAST_LAYER for m in found)


def test_odd_vectors_and_a_third_of_copies(spark):
    draw = np.random.default_rng(2)
    rows = [(i, draw.normal(size=3).tolist()) for i in range(100)] + [(i, [3.0, 1.0, 0.5]) for i in range(200, 250)]
    bad = [(500, None), (501, []), (502, [0.0, 0.0, 0.0]), (503, [float("nan"), 1.0, 1.0]), (504, [float("inf"), 1.0, 1.0]), (505, [None, 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(rows + bad + rows[:5], "vec_id long, embedding array<double>")
    frame = frame.withColumns({c: F.lit("own") for c in ("id", "vector", "shard", "block", "rank", "score")})
    asked = frame.where("vec_id in (3, 7, 200, 249, 500, 502, 503, 505)")
    got = lists(graph.nearest(frame, asked, k=20, shard_rows=40))
    best = exact(rows, [r for r in rows if r[0] in (3, 7, 200, 249)], 20)
    assert got.keys() == best.keys()
    for q in best:
        assert [i for i, _ in got[q]] == [i for i, _ in best[q]]


@pytest.mark.parametrize("n", [1, 24, 25, 26])
def test_every_other_node_of_a_small_shard_is_linked(n):
    points = np.random.default_rng(n).normal(size=(n, 4))
    edges, _ = graph.build(points)
    assert edges.shape == (n, graph.DEGREE)
    linked = [set(row[row >= 0].tolist()) for row in edges]
    if n <= graph.DEGREE + 1:
        assert linked == [set(range(n)) - {i} for i in range(n)]
    assert graph.beam_search(points, edges, 0, points, graph.SEARCH_BEAM)[0][:, 0].tolist() == list(range(n))


def test_copies_of_25_distinct_vectors(spark):
    draw = np.random.default_rng(25)
    distinct = draw.normal(size=(graph.DEGREE + 1, 3)).tolist()
    rows = [(i, distinct[i % len(distinct)]) for i in range(75)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = lists(graph.nearest(frame, frame.where("vec_id < 5")))
    best = exact(rows, rows[:5], 20)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in best.items()}


def test_few_and_no_rows(spark):
    few = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (3, [2.0])], "vec_id long, embedding array<double>")
    assert lists(graph.nearest(few, few)) == {1: [(2, 2.0), (3, 2.0)], 2: [(3, 4.0), (1, 2.0)], 3: [(2, 4.0), (1, 2.0)]}
    assert graph.nearest(few.limit(0), few).collect() == []
    assert graph.nearest(few, few.limit(0)).collect() == []
    with pytest.raises(ValueError, match="components"):
        graph.index(few.union(spark.createDataFrame([(4, [1.0, 2.0])], few.schema)))
