from __future__ import annotations

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tallymart.llm import mixing
from tests.oracle_check import difference


def test_exponent_meets_target_and_limit():
    tokens = [10_000, 500, 400, 100]
    x = mixing.exponent(tokens, 0.9, 1000.0, None)
    assert mixing.entropy(mixing.weights(tokens, x)) == pytest.approx(0.9 * math.log(4), abs=1e-9)
    x = mixing.exponent(tokens, 0.9, 4.0, None)
    w = mixing.weights(tokens, x)
    spent = mixing.whole_budget(tokens, w)
    assert max(a * spent / t for a, t in zip(w, tokens, strict=True)) == pytest.approx(4.0, rel=1e-6)
    assert mixing.exponent([7], 0.9, 4.0, None) == mixing.exponent([5, 5], 0.9, 4.0, None) == 1.0


@pytest.mark.parametrize("copies", [1, 3])
def test_equals_sql_on_uneven_sources(spark, documents, copies):
    uneven = documents.select("doc_id", "text", F.expr(
        "case when doc_id % 3 = 0 then 'hot' when doc_id % 11 = 1 then null when doc_id < 9 then 'tiny' else source end"
    ).alias("source"))
    for _ in range(copies - 1):
        uneven = uneven.union(documents.where("doc_id % 7 = 2").select("doc_id", "text", "source"))
    con = duckdb.connect()
    con.register("documents", uneven.toArrow())
    assert difference(mixing.mix(uneven), con, mixing.oracle()) is None


def test_small_blocks_and_a_given_budget(documents):
    rows = mixing.mix(documents, budget=40_000.0, block_docs=3).collect()
    spent: dict = {}
    for r in rows:
        key = (r["source"], r["epoch"])
        spent.setdefault(key, []).append((r["tokens_before"], r["n_tokens"], r["block_place"]))
    for turns in spent.values():
        turns.sort()
        assert turns[0][0] == 0 or turns[0][1] >= 0
        for (a, n, p), (b, _, q) in zip(turns, turns[1:]):
            assert b == a + n and q >= p  # blocks follow one another, documents too
    assert sum(r["n_tokens"] for r in rows) <= 40_000 + 20


def test_odd_rows(odd, clashing, nothing):
    rows = mixing.mix(odd).collect()
    assert {(r["doc_id"], r["source"]) for r in rows} >= {(1, "a"), (2, "a"), (7, "a"), (9, "c"), (3, None), (None, "c")}
    assert sum(r["doc_id"] == 2 and r["epoch"] == 1 for r in rows) == 2
    assert mixing.mix(nothing).collect() == []
    assert sorted(r["epoch"] for r in mixing.mix(odd.where("text is null")).collect()) == [1, 1]
    mixed = mixing.mixed_documents(clashing)
    assert mixed.columns == [*clashing.columns, "_epoch", "_block", "block_place", "tokens_before"]
    assert mixed.count() == len(rows)


def test_sources_without_a_word_are_kept(spark, documents):
    extra = [(-1, "", "y"), (-2, None, "y"), (-2, None, "y"), (-3, " \t", ""), (-4, "", None), (-5, "", "x"), (-6, "one two", "x")]
    more = spark.createDataFrame(extra, "doc_id long, text string, source string")
    docs = documents.select("doc_id", "text", "source").union(more)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    rows = mixing.mix(docs)
    assert difference(rows, con, mixing.oracle()) is None
    first = sorted(r["doc_id"] for r in rows.where("epoch = 1").collect())
    assert first == sorted(r["doc_id"] for r in docs.collect())
    assert rows.where("source = 'y'").count() == 3
    assert mixing.mixed_documents(more).where("epoch = 1").count() == 7
    given = mixing.mix(docs, budget=500.0).where("source = 'y' or source = ''")
    assert sorted(r["doc_id"] for r in given.collect()) == [-3, -2, -2, -1]
