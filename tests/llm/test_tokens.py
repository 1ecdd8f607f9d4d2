from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from tallymart.llm import tokens  # noqa: E402
from tallymart.llm.transducer import START, Transducer  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    with open(PATH, encoding="utf-8") as f:
        return tokens.Counter(f.read())


def exact(library, values):
    return [len(library.encode(v or "", add_special_tokens=False).ids) for v in values]


def test_random_texts(library, counter):
    draw = random.Random(3)
    parts = [*"ab'stredmvl 1٣½é́ΣİςßǅÅ<|>!?_- 　​日本語한\x1c\x85\n\t\U0001f600ﬁ²", "<|endoftext|>", "<|startoftext|>", "'s", "'ll", "'re", "é", "<|ENDOFTEXT|>"]
    values = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 40))) for _ in range(3000)]
    values += ["a" * 5000, "thandtion" * 3000, "日本" * 2000, "!" * 3000, "'" * 100 + "s", None]
    assert counter.count(values).tolist() == exact(library, values)


def test_documents(spark, documents, library, odd, clashing, nothing):
    for frame in (documents, odd, clashing):
        rows = [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]
        got = [tuple(r) for r in tokens.token_counts(frame, PATH).collect()]
        expected = [
            (i, len((t or "").encode()), n, n > 2048) for (i, t), n in zip(rows, exact(library, [t for _, t in rows]), strict=True)
        ]
        assert Counter(got) == Counter(expected)
    assert tokens.token_counts(nothing, PATH).collect() == []


def test_states_start_anew_at_the_bound(library, counter):
    machine = counter.machine
    before, machine.most_states = machine.most_states, 50
    words = [f"word{i}ing" for i in range(40)]
    got = [machine.count(w.encode()) for w in words]
    machine.most_states = before
    plain = ["".join(c for c in w if c.isalpha()) for w in words]
    assert len(machine.keys) < 500 and [counter.count([p])[0] for p in plain] == exact(library, plain)
    assert all(n > 0 for n in got)


def test_maps_of_chunks_compose():
    """A tiny vocabulary in which merges reach over many bytes."""
    base = list("abc") + [c + "</w>" for c in "abc"]
    merges = [("a", "b"), ("ab", "ab"), ("b", "c"), ("c", "a"), ("abab", "c"), ("ab", "ab</w>"), ("a", "b</w>"), ("c", "a</w>")]
    vocabulary = {t: i for i, t in enumerate([*base, *(a + b for a, b in merges)])}
    machine = Transducer(vocabulary, merges)
    draw = random.Random(1)
    for _ in range(300):
        word = "".join(draw.choice("abc") for _ in range(draw.randint(1, 60))).encode()
        plain = len(machine.tokenize(word, True))
        assert machine.count(word) == plain
        for size in (1, 3, 8):
            assert machine.count(word, size) == plain
        assert machine.scan([word[:5], word[5:]])[1] == machine.run(START, word)[1] if len(word) > 5 else True


def test_long_texts_are_counted_in_chunks(spark, library):
    draw = random.Random(12)
    parts = ["word", "it's", "12", "é", "e\u0301", "\u0301", "<|endoftext|>", "don't!", "日本", "Σ", "x" * 90]
    blanks = [" ", "\n", "\t", "\r\n", "\x0b", "\u3000", "\u2009", "", "", "  "]
    values = ["".join(draw.choice(parts) + draw.choice(blanks) for _ in range(draw.randint(0, 400))) for _ in range(60)]
    values += ["a" * 3000 + " " + "b" * 3000, " " * 2000, "'" * 500 + " s", "\u3000" * 700, None, ""]
    rows = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    for size in (1, 7, 64):
        cut = rows.select("doc_id", tokens.chunks(F.col("text"), size).alias("c")).collect()
        assert all("".join(r["c"] or []) == (values[r["doc_id"]] or "") for r in cut)
        found = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in tokens.token_counts(rows, PATH, chunk_chars=size).collect()}
        want = exact(library, values)
        assert found == {i: (len((v or "").encode()), n) for i, (v, n) in enumerate(zip(values, want, strict=True))}


def test_chunks_of_one_text_are_dealt_over_tasks(spark):
    text = "some words " * 20_000
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert len(rows.select(tokens.chunks(F.col("text"))).first()[0]) == -(-len(text) // tokens.CHUNK_CHARS)
    plan = tokens.token_counts(rows, PATH)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
