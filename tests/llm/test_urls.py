from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallymart.llm import queries, urls

RULES = queries.URL_RULES


def parts(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return host, path.split("?")[0].split("#")[0]


def rule(host: str, path: str) -> tuple[str, str] | None:
    best = None
    for text, verdict in RULES:
        domain, prefix = text.split("/", 1)
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + prefix):
            best = max(best or ("", ""), (text, verdict), key=lambda r: len(r[0]))
    return best


URLS = [
    None, "", "no scheme", "://", "http://", "http://ORG", "http://org/", "https://a.b.Example.ORG/es/x?y#z", "x://example.org/en/1",
    "http://example.org/en/12/", "http://badexample.org/en/1", "http://a.com/fr/1?u=http://org/", "http://a.com/de/",
    "http://com/de", "http://example.org?/es/", "http://example.org#/es/", "http://a://b/c", "HTTP://É.com/fr/", "http://x.net/" + "y" * 5000,
    "http://new\nline.org/\nes", "http://x.net/en/1", "http://x.net/en/1",
]


def test_rules_and_parts(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumns({c: F.lit("own") for c in ("host", "path", "rule", "r", "score")})
    got = {r["page_id"]: r for r in urls.judge(pages, RULES).collect()}
    for i, url in enumerate(URLS):
        host, path = parts(url)
        found = rule(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, found[0] if found else None), url
        assert got[i]["verdict"] == found[1] if found else got[i]["verdict"] in ("allow", "block")
    assert got[20]["verdict"] == got[21]["verdict"]


def test_the_ratio_tells_unseen_urls_apart(spark):
    rows = [(f"good{i}.net/recipes/{i * 7}", True) for i in range(300)] + [(f"spam{i}.net/casino/{i * 7}", False) for i in range(300)]
    model = urls.train(spark.createDataFrame(rows, "url string, allowed boolean"))
    scores = model.scores(pa.array(["good999.net/recipes/55555", "spam999.net/casino/55555"]))
    assert scores[0] >= model.threshold > scores[1]


def plain_probability(counts, url, k):
    """Of byte k of a URL, from a plain table of n-gram counts, order by order."""
    p = 1 / 256
    for order in range(urls.ORDER + 1):
        context = url[max(0, k - order) : k].rjust(order, b"\0") if order else b""
        # A context that the start cuts short is one of its own at that order.
        key = (order, context if k >= order else (url[:k], "cut"))
        seen = counts.get((key, url[k]), 0)
        whole = sum(n for (c, _), n in counts.items() if c == key)
        p = (seen + urls.PRIOR * p) / (whole + urls.PRIOR)
    return p


def test_scores_equal_a_plain_table(spark):
    """Counts of all n-grams but those of the calibration fold, and the ratio byte by byte."""
    rows = [(f"http://{w}{i}.net/{w}?q={i}#{w}", w == "good") for i in range(12) for w in ("good", "spam")] + [("", True)]
    known = spark.createDataFrame(rows, "url string, allowed boolean")
    model = urls.train(known)
    learned = known.where(F.pmod(F.xxhash64("url"), F.lit(urls.CALIBRATION_FOLDS)) != 0).collect()
    tables = [{}, {}]
    for r in learned:
        url = r["url"].encode()
        for k in range(len(url)):
            for order in range(urls.ORDER + 1):
                key = (order, (url[k - order : k] if order else b"") if k >= order else (url[:k], "cut"))
                entry = (key, url[k])
                tables[r["allowed"]][entry] = tables[r["allowed"]].get(entry, 0) + 1
    for value in ("http://good3.net/good?q=3", "spam", "x\u00e9", ""):
        url = value.encode()
        ratio = sum(
            np.log(plain_probability(tables[1], url, k)) - np.log(plain_probability(tables[0], url, k)) for k in range(len(url))
        ) / max(1, len(url))
        assert model.scores(pa.array([value]))[0] == pytest.approx(ratio, abs=1e-12)


def test_probabilities_sum_to_one():
    """Over all 256 next bytes, for a model of a few counts."""
    draw = np.random.default_rng(0)
    grams = np.concatenate([np.concatenate(list(urls._grams(draw.integers(97, 100, 30).astype(np.uint8), np.array([0, 30])))) for _ in range(2)])
    different, n = np.unique(grams, return_counts=True)
    model = urls.Model.of(different, np.stack([n, n]))
    prefix = np.array([97, 98, 99, 97], dtype=np.uint8)
    last = [model.probabilities(np.append(prefix, np.uint8(byte)), np.array([0, 5]))[0, -1] for byte in range(256)]
    assert sum(last) == pytest.approx(1.0, abs=1e-9)


def test_the_rarest_grams_make_way(spark):
    rows = [(f"http://good{i}.net/", True) for i in range(200)] + [(f"http://spam{i}.net/", False) for i in range(200)]
    known = spark.createDataFrame(rows, "url string, allowed boolean")
    whole, small = urls.train(known), urls.train(known, most_grams=300)
    assert len(small.grams) <= 300 < len(whole.grams)
    for model in (whole, small):
        scores = model.scores(pa.array(["http://good999.net/", "http://spam999.net/"]))
        assert scores[0] > scores[1]


def test_query_and_fragment_are_read(spark):
    rows = [(i, f"http://www.x.org/p?kind=good{i}") for i in range(100)] + [(100 + i, f"http://y.com/de/p?kind=casino{i}") for i in range(100)]
    rows += [(900, "http://other.net/p?kind=good7777"), (901, "http://other.net/p?kind=casino7777"), (902, "http://other.net/p#casino"), (903, "http://other.net/p#good")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: r["score"] for r in urls.judge(pages, RULES).where("page_id >= 900").collect()}
    assert got[900] > got[901] and got[903] > got[902]


def test_no_rules_no_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c"), (None, None)], "page_id long, url string")
    assert {r["verdict"] for r in urls.judge(pages, []).collect()} == {"allow"}
    assert urls.judge(pages.limit(0), RULES).collect() == []


def test_all_grams_count_and_blocks_make_no_difference(spark, monkeypatch):
    """No n-gram is left out by itself, and scores are those of the whole model however URLs are dealt."""
    assert len(urls.train(spark.createDataFrame([("http://a.net/", True)] * 5 + [(f"http://b{i}.net/", False) for i in range(9)], "url string, allowed boolean")).grams) > 20
    assert urls.train.__defaults__ == (None,)
    rows = [(i, f"http://www{i}.x.org/p{i * 7}") for i in range(60)] + [(100 + i, f"http://y.com/de/casino{i}") for i in range(60)]
    rows += [(300 + i, f"http://other{i % 20}.net/casino") for i in range(40)] + [(400, None), (401, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    known = spark.createDataFrame([(u, i < 100) for i, u in rows[:120]], "url string, allowed boolean")
    model = urls.train(known)
    expected = dict(zip([i for i, _ in rows], model.scores(pa.array([u or "" for _, u in rows])), strict=True))
    for size in (1 << 20, 200):
        monkeypatch.setattr(urls, "BLOCK_BYTES", size)
        got = urls.judge(pages, RULES).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r["score"] == pytest.approx(expected[r["page_id"]], abs=1e-12)
            if r["rule"] is None:
                assert r["verdict"] == ("allow" if r["score"] >= model.threshold else "block")
