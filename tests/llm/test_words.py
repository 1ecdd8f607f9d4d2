"""Words are told apart by their bytes: pairs that a sum of bytes times powers cannot part."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallymart.llm import decontaminate, maxent, text


def twins(a, b, n=1024):
    """A Thue-Morse word over two letters and its complement."""
    one = "".join((a, b)[bin(i).count("1") % 2] for i in range(n))
    return one, one.translate(str.maketrans(a + b, b + a))


PAIRS = [twins(*p) for p in ("sq", "on", "ab", "xy", "az", "tu")]


def hashes(values):
    w = text.words(*text.buffers(pa.array(values)))
    return w.hashes()


@pytest.mark.parametrize("pair", PAIRS, ids=lambda p: p[0][:2])
def test_twins_have_different_hashes(pair):
    assert len(set(hashes(list(pair)).tolist())) == 2


def test_hashes_depend_on_the_bytes_alone():
    draw = random.Random(1)
    values = ["".join(draw.choice("ab") for _ in range(draw.randint(1, 40))) for _ in range(4000)]
    together, apart = hashes([" ".join(values)]), np.concatenate([hashes([v]) for v in values])
    assert together.tolist() == apart.tolist()
    assert len(set(together.tolist())) == len(set(values))
    assert len({int(h) >> 44 for h in hashes([f"w{i}" for i in range(20_000)])}) > 19_000


def test_zero_bytes_count():
    assert len(set(hashes(["a", "a\0", "a\0\0", "\0a", "\0" * 8, "\0" * 9]).tolist())) == 6


def test_token_counts_of_twins():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    from tallymart.llm import tokens

    path = public_tokenizers.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        counter = tokens.Counter(f.read())
    values = [" ".join(p) for p in PAIRS] + [w for p in PAIRS for w in p]
    assert counter.count(values).tolist() == [len(library.encode(v, add_special_tokens=False).ids) for v in values]


def test_edit_distance_of_twins(spark):
    a, b = PAIRS[0]
    item = f"one two {a} three four"
    docs = spark.createDataFrame([(1, item), (2, item.replace(a, b))], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = {r["doc_id"]: r["edit_distance"] for r in decontaminate.leaks(docs, items).collect()}
    assert found == {1: 0, 2: 1}


def test_known_tokens_of_twins(spark):
    a, b = PAIRS[0]
    docs = spark.createDataFrame([(1, f"x {a}"), (2, f"x {b}")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in maxent.score_corpus(docs, docs.doc_id == 1).collect()}
    plain = Counter(["x", a, "end"])
    assert found[1]["train_tokens"] == sum(plain.values())
    assert (found[1]["n_known"], found[2]["n_known"]) == (3, 2)
