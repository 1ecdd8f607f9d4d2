from __future__ import annotations

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from tallymart.llm import decontaminate, mixing, queries, quality, simhash
from tests.llm.conftest import FOLDER
from tests.oracle_check import connect, difference


def test_stages_equal_their_operators(spark, documents):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    columns = documents.columns
    good = quality.with_score(documents, quality.train(documents, labels), name="s").where("s >= 0.3").drop("s")
    first = {r["component_id"] for r in simhash.near_duplicates(good).collect()}
    rest = good.where(good.doc_id.isin(sorted(first)))
    dirty = {r["doc_id"] for r in decontaminate.leaks(rest, items).collect()}
    clean = rest.where(~rest.doc_id.isin(sorted(dirty)))
    expected = sorted((r["doc_id"], r["epoch"]) for r in mixing.mix(clean).collect())
    result = corpus_pipeline.run(spark, FOLDER)
    assert result.columns == [*columns, "epoch", "block", "block_place", "tokens_before"]
    assert sorted((r["doc_id"], r["epoch"]) for r in result.collect()) == expected
    assert {i for i, _ in expected} == {r["doc_id"] for r in clean.collect()}


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_take_odd_and_empty_tables(spark, clashing, nothing, stage):
    result = stage[1](spark, clashing, FOLDER)
    assert result.columns[: len(clashing.columns)] == clashing.columns
    if stage != corpus_pipeline.STAGES[-1]:
        assert result.dtypes == clashing.dtypes
    result.collect()
    assert stage[1](spark, nothing, FOLDER).collect() == []


def test_registered():
    names = contract.queries()
    assert [n for n in names if n.startswith("op")] == list(queries.queries()) and len(queries.queries()) == 13
    assert "pipeline" in names and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    with connect(FOLDER) as con:
        assert difference(queries.queries()[name](spark, FOLDER), con, queries.oracle_sql()[name]) is None


def test_decontamination_takes_several_walks(spark, tmp_path, monkeypatch):
    """The stage drops a passage with an edit in the middle, found by walks that each have keys of their own."""
    item = "one two three four five six seven eight"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(
        [(1, f"here is {item.replace('five', 'other')} again"), (2, "eight seven six five four three two one"), (3, None)],
        "doc_id long, text string",
    )
    walks, regions = [], decontaminate.regions

    def seen(rows, table, klasses, reps):
        walks.append(reps)
        return regions(rows, table, klasses, reps)

    monkeypatch.setattr(decontaminate, "regions", seen)
    kept = corpus_pipeline.benchmark_decontamination(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in kept.collect()} == {2, 3}
    assert walks == [decontaminate.repetitions()] and walks[0] > 1
