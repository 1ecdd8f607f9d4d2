from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

from tallymart.llm import simhash


def brute(rows: list[tuple], shingle: int = 4, bits: int = 4) -> list[tuple]:
    """(doc_id, fingerprint, component_id) by comparing all pairs."""

    def fingerprint(value: str | None) -> int:
        data = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (value or "").encode())
        words = re.findall(rb"[^\x20\x09-\x0D]+", data)
        runs = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if runs else 0

    prints = [fingerprint(t) for _, t, *_ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    found = []
    for (own, *_), value, g in zip(rows, prints, group, strict=True):
        ids = [r[0] for r, h in zip(rows, group, strict=True) if h == g and r[0] is not None]
        found.append((own, f"{value:016x}", min(ids, default=None)))
    return found


def sorted_rows(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=str)


def test_odd_rows_equal_brute_force(odd, clashing):
    expected = sorted_rows(brute([tuple(r) for r in odd.collect()]))
    assert sorted_rows(simhash.near_duplicates(odd).collect()) == expected
    assert sorted_rows(simhash.near_duplicates(clashing).collect()) == expected


def test_documents_equal_brute_force(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert sorted_rows(simhash.near_duplicates(documents).collect()) == sorted_rows(brute(rows))


def test_empty(nothing):
    assert simhash.near_duplicates(nothing).collect() == []
    assert simhash.keep_first(nothing).collect() == []


def test_keep_first_keeps_columns_and_one_row_a_component(clashing):
    rows = brute([(r["doc_id"], r["text"]) for r in clashing.collect()])
    kept = simhash.keep_first(clashing)
    assert kept.columns == clashing.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids, key=str) == sorted({c for _, _, c in rows}, key=str)


def test_every_close_pair_shares_a_key():
    masks = [m & (1 << 64) - 1 for m in simhash.masks(7, 4)]
    assert len(masks) == 35
    draw = np.random.default_rng(0)
    for _ in range(300):
        far = sum(1 << int(b) for b in draw.choice(64, 4, replace=False))
        assert any(not far & m for m in masks)


@pytest.mark.parametrize("chunk", [2, 7, 1024])
def test_a_bucket_of_many_fingerprints_is_cut_into_chunks(spark, chunk):
    """A chain of near fingerprints, a dense ball, and strangers: components as by all pairs."""
    draw = np.random.default_rng(3)
    fps = [int(x) for x in draw.integers(-(2**62), 2**62, 40)]
    chain = [(1 << k) - 1 for k in range(0, 60, 3)]
    ball = [(5 << 40) ^ (1 << k) for k in range(30)]
    values = sorted(set(fps + chain + ball))
    edges = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), chunk=chunk).collect()
    group = {v: v for v in values}

    def top(v):
        while group[v] != v:
            v = group[v]
        return v

    for a, b in edges:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 64
        group[max(top(a), top(b))] = min(top(a), top(b))
    exact = {v: v for v in values}
    for a in values:
        for b in values:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                old, new = exact[a], exact[b]
                exact = {k: min(old, new) if g in (old, new) else g for k, g in exact.items()}
    assert {v: top(v) for v in values} == exact
