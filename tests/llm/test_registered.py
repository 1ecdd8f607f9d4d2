"""The registered queries themselves: columns, types, one row for each input row, and the rules that their contracts fix."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tallymart.llm import queries
from tests.llm.conftest import FOLDER

# Columns that the contracts name.
COLUMNS = {
    "op1_quality_nbsvm": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op4_warc_chunks": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op5_simhash_near_dedup": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op6_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op7_maxent_score": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op8_graph_search": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op10_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op11_lexical_search": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
    "op12_periodic_runs": {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"},
    "op13_personal_data": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
}


@pytest.fixture(scope="module")
def found(spark):
    """Rows of each query, computed once."""
    kept = {}

    def rows(name):
        if name not in kept:
            df = queries.queries()[name](spark, FOLDER)
            types = dict(df.dtypes)
            assert {c: types[c] for c in COLUMNS[name]} == COLUMNS[name]
            kept[name] = df.collect()
        return kept[name]

    return rows


def table(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet").collect()


def fold(value, n):
    return zlib.crc32(str(value).encode()) % n


@pytest.mark.parametrize("name", [n for n in COLUMNS if "doc_id" in COLUMNS[n] and "rank" not in COLUMNS[n]])
def test_one_row_for_each_document(spark, found, name):
    assert sorted(r["doc_id"] for r in found(name)) == sorted(r["doc_id"] for r in table(spark, "documents"))


@pytest.mark.parametrize("name", [n for n in COLUMNS if "page_id" in COLUMNS[n]])
def test_one_row_for_each_page(spark, found, name):
    assert sorted(r["page_id"] for r in found(name)) == sorted(r["page_id"] for r in table(spark, "pages"))


def test_quality_folds_and_threshold(found):
    for r in found("op1_quality_nbsvm"):
        assert r["held_out"] == (fold(r["doc_id"], 5) == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_language_model_folds(found):
    rows = found("op7_maxent_score")
    assert all(r["held_out"] == (fold(r["doc_id"], 7) == 2) for r in rows)
    assert {r["train_tokens"] for r in rows} == {sum(r["n_tokens"] for r in rows if not r["held_out"])}
    assert all(r["n_known"] == r["n_tokens"] for r in rows if not r["held_out"])


def test_archive_records(spark, found):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in table(spark, "pages")}
    groups = defaultdict(list)
    for i, payload in pages.items():
        groups[payload].append(i)
    for r in found("op4_warc_chunks"):
        payload = pages[r["page_id"]]
        first = max(groups[payload]) if len(payload) >= 1000 else r["page_id"]
        revisit = first != r["page_id"]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha1(payload).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", first) if revisit else ("response", None))


def test_fingerprints_and_components(found):
    rows = {r["doc_id"]: r for r in found("op5_simhash_near_dedup")}
    values = {i: int(r["fingerprint"], 16) for i, r in rows.items()}
    root = {i: i for i in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(rows)
    for a in ids:
        for b in ids:
            if a < b and (values[a] ^ values[b]).bit_count() <= 4:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    assert all(len(r["fingerprint"]) == 16 and r["component_id"] == top(i) for i, r in rows.items())


def test_verdicts(found):
    assert {r["verdict"] for r in found("op6_url_filter")} <= {"allow", "block"}
    rules = dict(queries.URL_RULES)
    assert all(r["rule"] is None or r["verdict"] == rules[r["rule"]] for r in found("op6_url_filter"))


def test_nearest_of_every_twentieth_vector(spark, found):
    vectors = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in table(spark, "embeddings")}
    lists = defaultdict(list)
    for r in sorted(found("op8_graph_search"), key=lambda r: (r["query_id"], r["rank"])):
        lists[r["query_id"]].append(r)
    assert set(lists) == {i for i in vectors if i % 20 == 0}
    hits = 0
    for q, rows in lists.items():
        assert [r["rank"] for r in rows] == list(range(1, 21))
        assert all(r["vec_id"] != q and r["score"] == pytest.approx(vectors[q] @ vectors[r["vec_id"]]) for r in rows)
        assert [(-r["score"], r["vec_id"]) for r in rows] == sorted((-r["score"], r["vec_id"]) for r in rows)
        nearest = sorted((-(vectors[q] @ x), i) for i, x in vectors.items() if i != q)[:20]
        hits += len({i for _, i in nearest} & {r["vec_id"] for r in rows})
    assert hits >= 0.9 * 20 * len(lists)


def test_token_counts_equal_the_library(spark, found):
    import public_tokenizers
    import tokenizers

    library = tokenizers.Tokenizer.from_file(str(public_tokenizers.path(queries.VOCABULARY)))
    library.no_truncation()
    library.no_padding()
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, "documents")}
    for r in found("op10_token_counts"):
        n = len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 2048)


def test_leaks_and_hashes(spark, found):
    leaks = queries.queries()["op3_decontaminate"](spark, FOLDER)
    assert "doc_id" in leaks.columns
    known = {r["doc_id"] for r in table(spark, "documents")}
    rows = leaks.collect()
    assert rows and {r["doc_id"] for r in rows} <= known
    for r in found("op12_periodic_runs"):
        assert (r["n_runs"] == 0) == (r["start"] is None) and len(r["runs_sha256"]) == len(r["collapsed_sha256"]) == 64
    for r in found("op13_personal_data"):
        kinds = [s.split(":")[0] for s in r["spans"].split(",") if s]
        assert len(r["base_sha256"]) == 64 and kinds.count("email") >= r["n_email"]


def test_ranks_are_unique_and_highest_first(found):
    lists = defaultdict(list)
    for r in found("op11_lexical_search"):
        lists[r["item_id"]].append((r["rank"], -r["score"], r["doc_id"]))
    for rows in lists.values():
        rows.sort()
        assert [k for k, *_ in rows] == list(range(1, len(rows) + 1)) and len(rows) <= 50
        assert [r[1:] for r in rows] == sorted(r[1:] for r in rows)
