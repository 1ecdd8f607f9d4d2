"""Periodic runs against a search over all periods and places."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tallymart.llm import queries, repeats
from tests.llm.conftest import FOLDER


def brute(words):
    """Every maximal stretch of each period, kept if no smaller period fits it."""
    w = np.unique(np.array(words, dtype=object), return_inverse=True)[1] if len(words) else np.zeros(0, int)
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        ends = np.flatnonzero(np.append(w[:-q] != w[q:], True))
        starts = np.concatenate(([0], ends[:-1] + 1))
        for i, j in zip(starts.tolist(), ends.tolist(), strict=True):
            if j > i and j + q - i >= max(6, 4 * q):
                part = w[i : j + q]
                if not any((part[:-p] == part[p:]).all() for p in range(1, q)):
                    out.append((i, j + q, q))
    return sorted(out)


def expected(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    runs = brute(words)
    dropped = {i for s, e, q in runs for i in range(s + q, e)}
    best = (None,) * 4
    if runs:
        from fractions import Fraction

        s, e, q = min(runs, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]))
        best = (s, e - s, q, 1000 * (e - s) // q)
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def described(texts):
    return [r[1:-1] for r in repeats.describe(pa.array(texts, pa.string()), False)]


def loops(draw, letters, n):
    words = [draw.choice(letters) for _ in range(n)]
    for _ in range(draw.randint(0, 3)):
        if n > 8:
            p, s = draw.randint(1, max(1, n // 5)), draw.randrange(n)
            for i in range(s + p, min(n, s + p * draw.randint(2, 9) + draw.randint(0, p))):
                words[i] = words[i - p]
    return words


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_random_loops(letters):
    draw = random.Random(letters)
    texts = [" ".join(loops(draw, "abcde"[:letters], draw.randint(0, 70))) for _ in range(800)]
    assert described(texts) == [expected(t) for t in texts]


def test_large_vocabulary():
    draw = random.Random(9)
    letters = [f"w{i}" for i in range(60)]
    texts = [" ".join(loops(draw, letters, draw.randint(100, 400))) for _ in range(100)]
    assert described(texts) == [expected(t) for t in texts]


TEXTS = [None, "", " \t\n", "one", "a " * 5, "a " * 6, "a\x0ba\ra\na\ta a", "a b " * 3, "a b " * 4, "a b " * 4 + "a", "A a " * 4,
         "x " + "a b c " * 4 + "a b d", "a a a a a a b " * 4, "é\xa0é " * 6, "\x00 " * 7]


def test_odd_texts():
    assert described(TEXTS) == [expected(t) for t in TEXTS]


def test_words_of_equal_sums_stay_apart():
    """Two words that differ at every second letter of a Thue-Morse word."""
    bits = "".join("oa"[bin(i).count("1") % 2] for i in range(1024))
    other = bits.translate(str.maketrans("oa", "ao"))
    text = f"{bits} {other} " * 6
    assert described([text]) == [expected(text)] and described([text])[0][3] == 2


def test_long_texts_in_good_time():
    draw = random.Random(4)
    n = 30_000
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    for words, count in [
        ([0] * n, 1), ([0, 1] * n, 1), (list(range(n)), 0), (b, 0), ([draw.randrange(300) for _ in range(300)] * 100, 1),
    ]:
        w = np.array(words)
        key, twice = repeats._pairs(w, np.zeros(len(w), dtype=int))
        assert len(repeats.runs_of(w, key, twice)) == count
    w = np.array([draw.randrange(2) for _ in range(5000)])
    key, twice = repeats._pairs(w, np.zeros(len(w), dtype=int))
    assert repeats.runs_of(w, key, twice) == brute(w.tolist())


def test_grammar_derives_the_text():
    draw = random.Random(2)
    for _ in range(200):
        w = np.array([draw.randrange(3) for _ in range(draw.randint(2, 80))])
        key, twice = repeats._pairs(w, np.zeros(len(w), dtype=int))
        pairs = {}
        for p in twice.tolist():
            pairs.setdefault((int(w[p]), int(w[p + 1])), []).append(p)
        made = repeats.repair(w.tolist(), 3, pairs)

        def text(symbol, made=made):
            return [symbol] if symbol < 3 else text(made.left[symbol - 3]) + text(made.right[symbol - 3])

        assert [x for s in made.last for x in text(s)] == w.tolist()
        places = made.occurrences(set(range(len(made.left))))
        for k, at in places.items():
            body = text(k + 3)
            assert len(at) >= 2 and all(w[p : p + len(body)].tolist() == body for p in at)
        pairs = list(zip(made.last, made.last[1:], strict=False))
        apart = [p for i, p in enumerate(pairs) if p[0] != p[1] or i == 0 or pairs[i - 1] != p]
        assert len(apart) == len(set(apart))


def test_frames(spark, odd, clashing, nothing):
    rows = repeats.periodic_runs(odd).collect()
    assert len(rows) == odd.count()
    texts = {(r["doc_id"], expected(r["text"])) for r in odd.collect()}
    assert {(r["doc_id"], tuple(r[2:9])) for r in rows} == texts
    assert sorted(map(str, repeats.periodic_runs(clashing).collect())) == sorted(map(str, rows))
    assert repeats.periodic_runs(nothing).collect() == []


def test_query_over_whole_table(spark, documents):
    texts = {}
    for r in documents.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        texts[r["doc_id"]] = " ".join(words)
    rows = queries.op12_periodic_runs(spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        assert tuple(r[1:]) == expected(texts[r["doc_id"]])
    assert any(r["n_runs"] for r in rows)
