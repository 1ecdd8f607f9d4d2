from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tallymart.llm import licenses
from tests.llm.conftest import prose


def words(value: str | None) -> list[str]:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), value or "")
    return re.findall("[a-z0-9\x80-\U0010ffff]+", lower)


def runs(value: str | None) -> list[tuple]:
    w = words(value)
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(rows, known):
    """Containment over whole documents, shingle by shingle."""
    found = []
    for doc, value in rows:
        have = runs(value)
        for template, name, body in known:
            own = set(runs(body))
            at = [i for i, g in enumerate(have) if g in own]
            share = len(own & set(have)) / len(own) if own else 0
            if share >= 0.8:
                found.append((doc, template, name, share, at[0], at[-1] - at[0] + 5))
    return sorted(found, key=str)


KNOWN = [(i, name, body) for i, (name, body) in enumerate(licenses.TEMPLATES)] + [(90, "none", "too short"), (91, "null", None)]


@pytest.fixture(scope="module")
def planted(spark):
    rows = []
    for i, (_, body) in enumerate(licenses.TEMPLATES):
        rows.append((i, f"{prose(i, 37)} {body.upper()} {prose(100 + i, 60)}"))
        cut = body.split()
        rows.append((100 + i, f"{prose(200 + i, 11)} {' '.join(cut[: max(5, len(cut) * 9 // 10)])}"))
        rows.append((200 + i, f"{' '.join(cut[: len(cut) // 2])} {prose(300 + i, 9)}"))
        # Foreign words in the middle: both parts lie in windows of their own.
        half = len(cut) // 2
        rows.append((400 + i, f"{prose(500 + i, 20 + i)} {' '.join(cut[:half])} {prose(600 + i, 25)} {' '.join(cut[half:])} {prose(700 + i, 5)}"))
    return rows + [(300, None), (301, ""), (302, "Released under"), (None, licenses.TEMPLATES[3][1]), (0, rows[0][1])]


@pytest.mark.parametrize("listed", [licenses.LISTED, 3])
def test_equals_brute_force(spark, planted, listed, monkeypatch):
    monkeypatch.setattr(licenses, "LISTED", listed)
    docs = spark.createDataFrame(planted, "doc_id long, text string").withColumns(
        {c: F.lit("own") for c in ("all", "words", "row", "at", "stride", "own")}
    )
    known = spark.createDataFrame(KNOWN, "template_id long, license string, text string")
    got = sorted((tuple(r) for r in licenses.scan(docs, known).collect()), key=str)
    assert got == brute(planted, [k for k in KNOWN if k[2]])
    assert len({g[1] for g in got}) == len(licenses.TEMPLATES)
    assert sum(g[0] is not None and 400 <= g[0] < 500 for g in got) >= 8


def test_nothing_to_scan_or_to_find(spark, odd, nothing):
    assert licenses.scan(nothing).collect() == []
    assert licenses.scan(odd).collect() == []
    none = spark.createDataFrame([], "template_id long, license string, text string")
    assert licenses.scan(odd, none).collect() == []


def test_no_python_runs(spark, documents):
    plan = licenses.scan(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
