from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tallymart.llm import decontaminate, text
from tests.llm.conftest import prose

ITEMS = [(i, prose(1000 + i, n)) for i, n in enumerate([5, 8, 15, 24, 33, 64, 100])]


def edited(value: str, edits: int, seed: int) -> str:
    draw, words = random.Random(seed), value.split()
    for k in range(edits):
        place = draw.randrange(len(words))
        kind = draw.randrange(3)
        if kind == 0:
            words[place] = f"changed{k}"
        elif kind == 1:
            del words[place]
        else:
            words.insert(place, f"added{k}")
    return " ".join(words)


def nearest(item: str, value: str) -> int:
    """Edits to the nearest passage, cell by cell."""
    a, b = item.lower().split(), value.lower().split()
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


@pytest.fixture(scope="module")
def planted(spark):
    rows = []
    for i, (item, body) in enumerate(ITEMS):
        for share in (0.0, 0.1):
            value = edited(body, math.floor(share * len(body.split())), i)
            rows.append((len(rows), f"{prose(2 * i, 70)} {value.upper() if i % 2 else value}, {prose(2 * i + 1, 50)}"))
    rows += [(100 + i, prose(5000 + i, 200)) for i in range(20)]
    return rows


def test_planted_passages_are_found_and_others_are_not(spark, planted):
    docs = spark.createDataFrame(planted, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["edit_distance"] for r in decontaminate.leaks(docs, items).collect()}
    expected = {}
    for doc, value in planted:
        for item, body in ITEMS:
            edits = nearest(body, value.replace(",", ""))
            if edits <= math.floor(0.2 * len(body.split())):
                expected[doc, item] = edits
    assert found == expected
    kept = {r["doc_id"] for r in decontaminate.clean(docs, items).collect()}
    assert kept == {d for d, _ in planted} - {d for d, _ in expected}


def test_recall_at_the_largest_distance():
    """Word edits of 20 % on items of many lengths: the share with a common key."""
    reps, draw, hits, tries = decontaminate.repetitions(), random.Random(4), 0, 0
    for seed in range(120):
        n = draw.choice([8, 15, 24, 40])
        item = prose(seed, n)
        value = prose(9000 + seed, 40) + " " + edited(item, math.floor(0.2 * n), seed) + " " + prose(8000 + seed, 40)
        klass = decontaminate.class_of(n)
        walk, width = decontaminate.Walks([klass], reps), decontaminate.shape(klass)[0]

        def keys(words, starts):
            return [set(k.tolist()) for _, k in walk.keys(words, {klass: starts})]

        a, _ = decontaminate.word_hashes(*text.buffers(pa.array([item])))
        b, first = decontaminate.word_hashes(*text.buffers(pa.array([value])))
        mine = keys(a, np.arange(len(a) - width + 1))
        theirs = keys(b, decontaminate._starts(first, *decontaminate.shape(klass)))
        hits += any(x & y for x, y in zip(mine, theirs, strict=True))
        tries += 1
    assert hits / tries >= decontaminate.TARGET_RECALL


@pytest.mark.parametrize("kind", ["substitutions", "deletions", "insertions", "even substitutions"])
@pytest.mark.parametrize("n", [4, 5, 8, 10, 15, 16, 32, 64, 128, 256, 512])
def test_every_passage_at_the_largest_distance_shares_a_key(n, kind):
    """Edits of one kind, up to 20 % of the words, at every offset of the document."""
    klass, reps, most = decontaminate.class_of(n), decontaminate.repetitions(), math.floor(0.2 * n)
    walk, (width, stride) = decontaminate.Walks([klass], reps), decontaminate.shape(klass)
    for trial in range(30):
        draw = random.Random(1000 * n + trial)
        item = np.array([draw.getrandbits(64) for _ in range(n)], dtype=np.uint64)
        words = item.tolist()
        places = sorted(draw.sample(range(n), most), reverse=True)
        if kind == "even substitutions":
            places = [(k + 1) * (n + 1) // (most + 1) - 1 for k in range(most)]
        for place in places:
            if kind == "deletions":
                del words[place]
            elif kind == "insertions":
                words.insert(place, draw.getrandbits(64))
            else:
                words[place] = draw.getrandbits(64)
        before = [draw.getrandbits(64) for _ in range(draw.randrange(2 * n))]
        body = np.array(before + words + [draw.getrandbits(64) for _ in range(n)], dtype=np.uint64)
        first = np.array([0, len(body)])

        def keys(value, starts):
            return [set(k.tolist()) for _, k in walk.keys(value, {klass: starts})]

        mine = keys(item, np.arange(n - width + 1))
        theirs = keys(body, decontaminate._starts(first, width, stride))
        assert any(x & y for x, y in zip(mine, theirs, strict=True)), trial


def test_passage_equals_a_plain_table():
    draw = random.Random(2)
    for _ in range(200):
        item = np.array([draw.randrange(4) for _ in range(draw.randint(1, 12))], dtype=np.uint64)
        words = np.array([draw.randrange(4) for _ in range(draw.randint(0, 30))], dtype=np.uint64)
        edits, first, length = decontaminate.passage(item, words)
        assert edits == nearest(" ".join(map(str, item)), " ".join(map(str, words)))
        body = words[first : first + length]
        assert nearest(" ".join(map(str, item)), " ".join(map(str, body))) == edits


def test_odd_rows(spark, odd, clashing, nothing):
    long = odd.where("doc_id = 7").first()["text"]
    items = spark.createDataFrame(
        [(1, " ".join(long.split()[19_950:])), (2, None), (3, ""), (4, "one two"), (None, " ".join(long.split()[:30])), (5, " ".join(long.split()[:30]))],
        "item_id long, text string",
    )
    pairs = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(clashing, items).collect()}
    # The item of two words is all of document 9.
    assert pairs == {(7, 1), (8, 1), (7, None), (8, None), (7, 5), (8, 5), (9, 4)}
    kept = decontaminate.clean(clashing, items)
    assert kept.columns == clashing.columns and kept.count() == 10
    assert decontaminate.leaks(nothing, items).collect() == []
    assert decontaminate.leaks(odd, items.limit(0)).collect() == []
    only = decontaminate.leaks(odd, items.where("item_id = 4")).collect()
    assert [tuple(r) for r in only] == [(9, 4, 0, 2, 0, 2)]


def test_short_items_are_found_word_for_word(spark):
    items = [(1, "Paris"), (2, "blue whale"), (3, "to be or"), (4, "...")]
    texts = ["the capital is PARIS.", "a blue, whale", "blue big whale", "whale blue", "it is to be or not", "to be, not or", "parisian", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"], r["edit_distance"], r["first_word"], r["passage_words"]) for r in found}
    assert got == {(0, 1, 0, 3, 1), (1, 2, 0, 1, 2), (4, 3, 0, 2, 3)}


def test_common_word_pairs_are_no_keys(spark):
    """Documents and items over a small, skewed vocabulary: few candidates, and every copy with an edit is found."""
    draw = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(300)]

    def prose(n):
        return [vocabulary[i] for i in np.minimum(draw.zipf(1.3, n) - 1, 299)]

    items = [prose(6) for _ in range(56)]
    docs = [prose(300) for _ in range(56)]
    for d in range(0, 56, 8):
        copy = list(items[d])
        if d % 16:
            copy[draw.integers(0, 6)] = "other"
        docs[d][100:106] = copy
    rows = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    wanted = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(rows, wanted).collect()}
    exact = {(d, i) for d, words in enumerate(docs) for i, item in enumerate(items) if near(item, words)}
    assert found == exact and all((d, d) in found for d in range(0, 56, 8))


def near(item, words):
    """Whether a passage of ``words`` is one word edit or none away from six words, by trying all lengths."""
    for a in range(len(words) - 4):
        for n in (5, 6, 7):
            part = words[a : a + n]
            if len(part) == n == 6 and sum(x != y for x, y in zip(part, item)) <= 1:
                return True
            short, long = (part, item) if n == 5 else (item, part)
            if len(part) == n != 6 and any(long[:i] + long[i + 1 :] == short for i in range(len(long))):
                return True
    return False


def test_several_walks_meet_windows_with_an_edit():
    """An edit lies within the window; some walks read around it, others do not."""
    reps = decontaminate.repetitions()
    assert reps > decontaminate.repetitions(0.9) > 1
    walk, draw, shared = decontaminate.Walks([2], reps), np.random.default_rng(6), []
    for _ in range(40):
        item = draw.integers(1, 1 << 62, size=16, dtype=np.int64).view(np.uint64)
        other = item.copy()
        other[4] = 7
        start = {2: np.zeros(1, dtype=np.int64)}
        shared.append([a[1][0] == b[1][0] for a, b in zip(walk.keys(item, start), walk.keys(other, start), strict=True)])
        assert len(shared[-1]) == reps
    assert 0.1 < np.mean(shared) < 0.9 and np.mean(np.any(shared, axis=1)) > 0.9


@pytest.mark.parametrize("n", [5, 6, 9, 10, 15, 16, 20, 31, 40, 80])
def test_walks_agree_as_the_number_of_repetitions_assumes(n):
    """The share of walks that hit a passage with 20 % edits, evenly spread ones being worst."""
    klass, most = decontaminate.class_of(n), math.floor(0.2 * n)
    walk, width = decontaminate.Walks([klass], 24), decontaminate.shape(klass)[0]
    for kind in ("substitute", "delete", "insert"):
        hits = []
        for trial in range(20):
            draw = random.Random(100 * n + trial)
            words = [draw.getrandbits(64) for _ in range(n)]
            body = list(words)
            for k in reversed(range(most)):
                place = (k + 1) * (n + 1) // (most + 1) - 1
                new = [] if kind == "delete" else [draw.getrandbits(64)]
                body[place : place + (kind != "insert")] = new
            body = [draw.getrandbits(64) for _ in range(9)] + body + [draw.getrandbits(64) for _ in range(20)]

            def keys(value):
                at = {klass: np.arange(len(value) - width + 1)}
                return [set(k.tolist()) for _, k in walk.keys(np.array(value, dtype=np.uint64), at)]

            hits += [bool(x & y) for x, y in zip(keys(words), keys(body), strict=True)]
        assert np.mean(hits) >= decontaminate.AGREEMENT**decontaminate.SAMPLED, kind


def test_all_places_at_once_give_the_lower_half_of_each_key(monkeypatch):
    monkeypatch.setattr(decontaminate, "_BLOCK", 50)
    words = np.random.default_rng(3).integers(1 << 62, size=180, dtype=np.int64).view(np.uint64)
    words[[40, 49, 50, 120, 179]] = 0
    klasses = [0, 1, 2, 5, *(decontaminate.CLASSES + n for n in (1, 2, 3))]
    walk = decontaminate.Walks(klasses, 3)
    seen = 0
    for kind, rep, first, low in walk.low(words):
        key = walk.full(words, np.arange(first, first + len(low)), kind, rep)
        assert (key.astype(np.uint32) == low).all()
        seen += len(low)
    assert seen == 180 * (3 * 3 + 3)


@pytest.mark.parametrize("places", [(4, 8, 9), (4, 8, 10), (3, 8, 9)])
def test_close_deletions_are_hit_as_often_as_the_number_of_repetitions_assumes(places):
    """Shortest items of their class that keep the fewest windows, as whole documents."""
    reps, draw = decontaminate.repetitions(), np.random.default_rng(places)
    walk, width = decontaminate.Walks([2], reps), decontaminate.shape(2)[0]
    hits = []
    for _ in range(400):
        item = draw.integers(1, 1 << 62, size=16, dtype=np.int64).view(np.uint64)

        def keys(value):
            return [set(k.tolist()) for _, k in walk.keys(value, {2: np.arange(len(value) - width + 1)})]

        hits.append([bool(x & y) for x, y in zip(keys(item), keys(np.delete(item, places)), strict=True)])
    share = np.mean(hits)
    assert share >= decontaminate.AGREEMENT**decontaminate.SAMPLED
    assert (1 - share) ** reps <= 1 - decontaminate.TARGET_RECALL


def test_flags_in_bytes_are_those_of_the_table():
    draw = np.random.default_rng(9)
    table = draw.random(1 << decontaminate.FILTER_BITS) < 0.1
    key = draw.integers(1 << 32, size=5000, dtype=np.uint32)
    found = decontaminate._flagged(np.packbits(table), key)
    assert found.tolist() == [i for i, k in enumerate(key.tolist()) if table[k & int(decontaminate._MASK)]]
