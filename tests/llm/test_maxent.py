from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallymart.llm import maxent


def words(value: str | None) -> list:
    data = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (value or "").encode())
    return [*re.findall(rb"[^\x20\x09-\x0D]+", data), None]


def check_base(rows, train, found):
    counts = Counter(w for _, t in train for w in words(t))
    total, distinct = sum(counts.values()), len(counts)
    expected = []
    for i, t in rows:
        own = words(t)
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own)
        expected.append((i, len(own), sum(counts[w] > 0 for w in own), total, round(base, 6)))
    got = [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_base_is_exact_and_the_model_is_better(documents):
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    rows = [(r["doc_id"], r["text"], r["held"]) for r in documents.withColumn("held", held).collect()]
    found = maxent.score_corpus(documents, ~held).collect()
    check_base([r[:2] for r in rows], [r[:2] for r in rows if not r[2]], found)
    out = {r[0] for r in rows if r[2]}
    unseen = [r for r in found if r["doc_id"] in out]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def test_words_outside_the_head_meet_their_counts(documents, monkeypatch):
    """With a tiny head nearly all counts come by the join."""
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    counts = maxent.word_counts(documents)
    small = maxent.vocabulary(counts, head=100)
    assert len(small.by_rank) == 100
    check_base(rows, rows, maxent.scores(documents, F.lit(True), counts, small).collect())


def vocabulary(counts: dict[int, int], distinct: int, total: int) -> maxent.Vocabulary:
    """A head of numbered words, END as one of them, and a rest that is only counted."""
    ranked = sorted(counts.items(), key=lambda c: (-c[1], c[0]))
    return maxent.Vocabulary(
        np.array([h for h, _ in ranked], dtype=np.uint64), np.array([n for _, n in ranked], dtype=np.int64), total, distinct
    )


def events(seed: int = 3):
    """Distinct events over a head of 200 words, two ranks of rarer contexts and words outside the head."""
    draw = np.random.default_rng(seed)
    word = np.minimum(draw.geometric(0.03, 6000) - 1, 200)
    word[word == 200] = maxent.HEAD
    context = np.where(word == maxent.HEAD, maxent.START + 1 + draw.integers(0, 50, len(word)), word)
    one, two = np.roll(context, 1), np.roll(context, 2)
    found, n = np.unique(np.stack((one, two, word)), axis=1, return_counts=True)
    v = vocabulary({i + 10: int((word == i).sum()) for i in range(200)}, 260, len(word))
    # Ranks go by count, so the numbers of the words are mapped to them.
    rank = {int(h) - 10: r for h, r in zip(v.hashes, v.ranks)}
    mapped = [np.array([rank.get(int(x), int(x)) for x in row]) for row in found]
    return v, *mapped, n


def test_probabilities_sum_to_one():
    """Over the head and the last class, in contexts seen and unseen; what is only scored has a count of zero."""
    v, one, two, word, n = events()
    every = np.append(np.arange(len(v.by_rank)), maxent.HEAD)
    chosen = [*zip(one[:40], two[:40]), (maxent.START, maxent.START), (7, 1 << 30), (1 << 30, 3)]
    chosen = sorted(set(chosen))
    grid = np.array([(a, b, w) for a, b in chosen for w in every]).T
    known = dict(zip(zip(one.tolist(), two.tolist(), word.tolist()), n.tolist()))
    counts = np.array([known.pop(e, 0) for e in map(tuple, grid.T.tolist())])
    more = np.array(list(known)).T  # the rest of the training events
    both = np.concatenate((grid, more), axis=1)
    logs = maxent.Shard(v, *both, np.concatenate((counts, list(known.values())))).logs[: len(counts)]
    assert np.exp(logs).reshape(len(chosen), -1).sum(axis=1) == pytest.approx(np.ones(len(chosen)), abs=1e-5)


def test_scores_equal_dense_softmaxes():
    """Softmaxes over all classes and all words of the class, one weight at a time."""
    v, one, two, word, n = events()
    shard = maxent.Shard(v, one, two, word, n)
    rows = np.stack(shard.rows(one, two, maxent._pair(one, two)), axis=1)
    after = dict(zip(shard.entries.tolist(), shard.after.tolist()))
    pairs = dict(zip(zip(one.tolist(), two.tolist(), word.tolist()), shard.pairs.tolist()))
    for i in np.random.default_rng(5).integers(0, len(one), 60):
        z = [float(v.class_share[k]) + sum(float(shard.outer[r, k]) for r in rows[i]) for k in range(maxent.CLASSES)]
        klass = maxent.CLASSES - 1 if word[i] == maxent.HEAD else int(v.klass[word[i]])
        expected = z[klass] - math.log(sum(map(math.exp, z)))

        def logit(w):
            entry = maxent.Shard.entry(int(one[i]), klass, w)
            return math.log(v.by_rank[w] + 1) + after.get(entry, 0.0) + pairs.get((int(one[i]), int(two[i]), w), 0.0)

        if word[i] < maxent.HEAD:
            members = [w for w in range(len(v.by_rank)) if v.klass[w] == klass]
            expected += logit(int(word[i])) - math.log(sum(math.exp(logit(w)) for w in members))
        assert shard.logs[i] == pytest.approx(expected, abs=1e-4)


def test_weights_of_words_are_at_the_optimum():
    """Observed less expected counts equal the pull of the prior; entries not seen weigh nothing."""
    draw = np.random.default_rng(2)
    group = np.sort(draw.integers(0, 50, 1000))
    prior = draw.random(1000) / 60
    n = draw.integers(0, 5, 1000).astype(float)
    weight, norm = maxent.boosts(group, prior, n)
    assert not weight[n == 0].any()
    total = np.bincount(group, n)[group]
    expected = total * prior * np.exp(weight - norm)
    seen = n > 0
    left = np.abs(n - expected - maxent.PRIOR * weight)[seen]
    assert np.median(left) < 0.02 and left.max() < 0.2
    for g in range(50):
        own = group == g
        assert norm[own][0] == pytest.approx(math.log(1 + (prior[own] * np.expm1(weight[own])).sum()))


def test_words_are_found_by_their_hashes():
    draw = np.random.default_rng(4)
    hashes = draw.integers(0, 1 << 64, 5000, dtype=np.uint64)
    v = maxent.Vocabulary(hashes, np.arange(5000, 0, -1), 20_000_000, 6000)
    ends = np.array([0, (1 << 64) - 1], dtype=np.uint64)
    others = np.concatenate((draw.integers(0, 1 << 64, 5000, dtype=np.uint64), ends))
    assert v.find(hashes).tolist() == list(range(5000))
    assert set(v.find(others)) == {maxent.HEAD}


def held_out_gain(documents, parts: int) -> list:
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    found = maxent.score_corpus(documents.repartition(parts), ~held)
    return sorted((r["doc_id"], r["score"]) for r in found.collect())


def test_the_number_of_tasks_does_not_matter(documents, monkeypatch):
    """Several shards, so that frequent words are spread, in one task and in many."""
    monkeypatch.setattr(maxent, "SHARD_BYTES", 1 << 16)
    few, many = held_out_gain(documents, 1), held_out_gain(documents, 13)
    assert [d for d, _ in few] == [d for d, _ in many]
    assert [s for _, s in few] == pytest.approx([s for _, s in many], rel=1e-3)


def test_frequent_words_and_pairs_are_spread():
    v = vocabulary({1: 3_000_000_000, 2: 2_000_000_000, 3: 5}, 3, 5_000_000_005)
    spread = maxent.Spread(v, 10_000, 1.0)
    draw = np.random.default_rng(1)
    size = 100_000
    salt = draw.integers(0, 1 << 62, size).astype(np.uint64)
    hot = spread.shard(np.zeros(size, np.int64), np.ones(size, np.int64), salt)
    # No shard gets more of the pair than a few times its tokens.
    assert np.bincount(hot).max() / size * 2_000_000_000 < 40 * maxent.SHARD_TOKENS
    rare = spread.shard(np.full(size, 2), draw.integers(0, 1 << 30, size), salt)
    assert len(np.unique(rare)) == 1
    wide = spread.shard(np.zeros(size, np.int64), draw.integers(0, 1 << 30, size), salt)
    assert len(np.unique(wide)) > 2_000


def test_odd_rows(odd, clashing, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    found = maxent.score_corpus(clashing, F.lit(True)).collect()
    check_base(rows, rows, found)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in found)
    assert maxent.score_corpus(nothing, F.lit(True)).collect() == []
    untrained = maxent.score_corpus(odd, F.lit(False)).collect()
    check_base(rows, [], untrained)
    assert all(math.isfinite(r["score"]) for r in untrained)


def test_a_shard_lets_go_of_its_events(monkeypatch):
    """Bodies are given up before the weights are made, and views of a batch do as well as bytes."""
    draw = np.random.default_rng(5)
    hashes = np.sort(draw.integers(1, 1 << 62, 40).astype(np.uint64))
    v = maxent.Vocabulary(hashes, np.arange(40, 0, -1), 820, 40)
    columns = [draw.integers(0, 40, 300) for _ in range(3)]
    _, bodies = maxent.packed(np.zeros(300, dtype=np.int64), columns, np.repeat(np.arange(30), 10))
    left, made = [], maxent.Shard.__init__
    given = [pa.py_buffer(b) for b in bodies]
    monkeypatch.setattr(maxent.Shard, "__init__", lambda self, *a: (left.append(len(given)), made(self, *a))[1])
    (rows, sums), = maxent.shard_scores(v, given)
    assert left == [0] and rows.tolist() == np.repeat(np.arange(15), 2).tolist() and (sums < 0).all()
