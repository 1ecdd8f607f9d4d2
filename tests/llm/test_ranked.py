"""Ranked search against plain Python integers, and DuckDB in test_pipeline."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tallymart.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k=50):
    """Rows (item_id, rank, doc_id, score)."""
    cut = [(i, split(t)) for i, t in docs]
    n_docs = sum(1 for _, w in cut if w)
    total = sum(len(w) for _, w in cut)
    out = []
    for item, text in items:
        terms = set(split(text))
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in w for _, w in cut) + 1))) for t in terms} if n_docs else {}
        rows = []
        for i, words in cut:
            score = 0
            for t in terms:
                tf = words.count(t)
                if tf:
                    m = 50 + 50 * len(words) * n_docs // total
                    score += weight[t] * (10**9 * tf // (1000 * tf + 20 * m))
            if score > 0:
                rows.append((-score, i is not None, i, score))
        rows.sort(key=lambda r: (r[0], r[1], r[2] if r[1] else 0))
        out += [(item, rank, r[2], r[3]) for rank, r in enumerate(rows[:k], 1)]
    return sorted(out, key=str)


def result(spark, docs, items, kinds="doc_id long, text string", parts=3, **more):
    d = spark.createDataFrame(docs, kinds).repartition(parts)
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in ranked.search(d, i, **more).collect()), key=str)


def small(seed, n_docs=120, n_items=9):
    draw = random.Random(seed)
    words = ["the", "The", "a", "b1", "é", "Ünï", "x", "日本", *[f"w{i}" for i in range(30)]]
    texts = ["".join(draw.choice(words) + draw.choice([" ", "-", "_", "\x00", "\n", "."]) for _ in range(draw.randint(0, 40))) for _ in range(n_docs)]
    texts[5] = texts[6] = texts[7]
    texts[8], texts[9] = None, " -- "
    return list(enumerate(texts)), [(100 + i, t) for i, t in enumerate(texts[: n_items - 2])] + [(1, None), (2, "")]


@pytest.mark.parametrize("k", [1, 3, 50])
def test_equals_plain_integers(spark, k):
    docs, items = small(k)
    assert result(spark, docs, items, k=k) == brute(docs, items, k)


def test_many_blocks_of_items_and_small_tiles(spark, monkeypatch):
    docs, items = small(7)
    assert result(spark, docs, items, block_bytes=300) == brute(docs, items)


def test_column_tiles_keep_sums_exact(monkeypatch):
    """With a low bound on partial sums products are cut into single columns and still add up."""
    draw = random.Random(1)
    items = ranked.Items.of(pa.array([1, 2]), pa.array(["a b c d", "c d e"]))
    weights = np.array([draw.randint(1, 30_000) for _ in range(5)])
    row, term = np.nonzero(np.ones((4, 5)))
    impact = np.array([draw.randint(1, 10**6 - 1) for _ in row])
    want = [[sum(int(weights[t]) * int(impact[5 * d + t]) for t in held) for held in items.held] for d in range(4)]
    for bound in (ranked.EXACT, 1 << 36, 1):
        monkeypatch.setattr(ranked, "EXACT", bound)
        (parts,) = ranked.tiles(items, weights)
        assert (len(parts) == 1) == (bound == 1 << 53)
        assert ranked.score_tile(parts, 4, row, term, impact).tolist() == want


def test_ties_of_many_copies_keep_the_smallest_ids(spark, monkeypatch):
    docs = [(5000 - i, "same words here") for i in range(5000)] + [(9000 + i, f"same other{i}") for i in range(200)]
    got = result(spark, docs, [(1, "words same"), (1, "words same")], parts=7)
    want = sorted([(1, r, r, got[0][3]) for r in range(1, 51)] * 2, key=str)
    assert got == want


def test_rows_kept_by_a_task_are_cut_by_score_then_id():
    best = ranked.Best(2, 2, pa.int64())
    best.add(np.array([0, 1]), pa.array([7, 5, 6, None]), np.array([[5, 0], [5, 1], [4, 0], [5, 0]]))
    table = best.cut()
    assert table.to_pydict() == {"item": [0, 0, 1], "score": [5, 5, 1], "doc_id": [None, 5, 5]}
    best.add(np.array([0, 1]), pa.array([1, 2]), np.array([[5, 9], [4, 1]]))
    assert best.cut().to_pydict() == {"item": [0, 0, 1, 1], "score": [5, 5, 9, 1], "doc_id": [None, 1, 1, 2]}


def test_lengths_beyond_64_bits():
    n = np.array([10, 1 << 40])
    tf = np.array([3, 5])
    docs, total = 1 << 40, 1 << 52
    want = [10**9 * t // (1000 * t + 20 * (50 + 50 * int(x) * docs // total)) for t, x in zip(tf.tolist(), n, strict=True)]
    assert ranked.impacts(tf, n, docs, total).tolist() == want


def test_odd_tables(spark, odd, clashing, nothing):
    items = spark.createDataFrame([(1, "one TWO Ünïcode"), (2, None)], "item_id long, text string")
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = brute(docs, [(1, "one TWO Ünïcode"), (2, None)])
    assert want
    for df in (odd, clashing):
        assert sorted((tuple(r) for r in ranked.search(df, items).collect()), key=str) == want
    assert ranked.search(nothing, items).collect() == []
    assert ranked.search(odd, items.limit(0)).collect() == []
    named = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x")], "doc_id string, text string")
    rows = ranked.search(named, spark.createDataFrame([("q", "y")], "item_id string, text string")).collect()
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in rows] == [("q", 1, "a"), ("q", 2, "b")]
