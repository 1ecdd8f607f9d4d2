from __future__ import annotations

import hashlib

import pytest

from tallymart.llm import warc
from tallymart.session import fresh_path

PAGES = [
    (1, "http://a/\r\nWARC-Type: x", "a" * 50 + "WARC/1.1\r\nWARC-Type: revisit\r\n\r\n" + "é" * 100),
    (2, None, None),
    (3, "http://x/é?q=\x01", ""),
    (4, "x", "ends in WARC/1.1"),
    (5, "y", "é\U0001f600" * 3000),
    (None, "x", "é\U0001f600" * 3000),
    (9, "y", "é\U0001f600" * 3000),
    (9, "again", "é\U0001f600" * 3000),
    (6, "z", "\r\nWARC/1.1\r\n" * 30),
    (6, "z", "q"),
    (7, "s", "short"),
    (8, "s", "short"),
    (10, "long", "0123456789" * 200_000),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


@pytest.mark.parametrize("size", [16, 41, 1 << 16])
@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_round_trip(spark, pages, size, compression):
    part = pages if size > 100 else pages.where("page_id is null or page_id < 9")
    given = [p for p in PAGES if size > 100 or p[0] is None or p[0] < 9]
    path = warc.write(part, fresh_path(spark, "warc"), chunk_bytes=size, compression=compression)
    got = sorted((tuple(r)[:5] for r in warc.payloads(warc.read(spark, path)).collect()), key=str)
    expected = []
    for page, _, html in given:
        data = (html or "").encode()
        same = [p for p, _, h in given if (h or "").encode() == data and p is not None]
        revisit = len(data) >= 1000 and same and page != max(same)
        expected.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    assert got == sorted(expected, key=str)


def test_chunks_join_to_the_payload_and_hide_the_mark():
    for value in ("", "WARC/1.1", "xWARC/1.1\r\nWARC/1.1", "é" * 99, "a" * 1000):
        data = value.encode()
        parts = [bytes(c) for c in warc.chunks(data, 17)]
        assert b"".join(parts) == data and all(len(p) <= 17 and warc.TOKEN not in p for p in parts)
        assert all(p.decode() == p.decode("utf-8", "strict") for p in parts)


def test_files_follow_the_format(spark, pages):
    path = warc.write(pages.where("page_id = 7"), fresh_path(spark, "warc"), compression="none")
    body = "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    assert body.startswith("WARC/1.1\r\nWARC-Type: warcinfo\r\n") and body.count("WARC/1.1\r\n") == 2
    assert "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:7:" in body
    assert "Content-Type: text/html; charset=utf-8\r\n" in body
    assert body.endswith("Content-Length: 5\r\n\r\nshort\r\n\r\n")


def test_a_missing_chunk_raises(spark, pages):
    path = warc.write(pages.where("page_id = 10"), fresh_path(spark, "warc"))
    table = warc.read(spark, path)
    assert table.count() > 20
    with pytest.raises(Exception, match="missing or altered"):
        warc.payloads(table.where("chunk <> 3")).collect()


def test_empty_and_clashing_columns(spark, pages):
    from pyspark.sql import functions as F

    path = warc.write(pages.limit(0), fresh_path(spark, "warc"))
    assert warc.payloads(warc.read(spark, path)).collect() == []
    more = pages.withColumns({c: F.lit("own") for c in ("digest", "size", "same", "top", "record", "value")})
    path = warc.write(more, fresh_path(spark, "warc"))
    assert warc.payloads(warc.read(spark, path)).count() == len(PAGES)


def foreign(kind, name, block, fields=(), version="1.0"):
    """A record as another writer makes it, in another order of fields."""
    head = [f"WARC/{version}", *fields, f"Content-Length: {len(block)}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Type: {kind}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
PAGE = "<p>é\r\n\r\nsecond</p>".encode()
RECORDS = [
    foreign("warcinfo", "a0", b"software: other\r\n", ["Content-Type: application/warc-fields"]),
    foreign("request", "a1", b"GET / HTTP/1.1\r\n\r\n", ["WARC-Target-URI: http://x.org/", "Content-Type: application/http; msgtype=request"]),
    foreign("response", "a2", HTTP + PAGE, ["WARC-Target-URI: http://x.org/", "Content-Type: application/http; msgtype=response"]),
    foreign("resource", "a3", b"\xff\xfe\x00bytes", ["WARC-Target-URI: <http://x.org/b>", "content-type: image/png"], "1.1"),
    foreign("response", "a4", HTTP, ["WARC-Target-URI: http://x.org/empty", "Content-Type: application/http; msgtype=response"]),
    foreign("revisit", "a5", b"", ["WARC-Refers-To: <urn:uuid:a2>", "WARC-Payload-Digest: sha1:ABCDEFGH234567"], "1.1"),
    foreign("resource", "a6", b"", []),
]


@pytest.mark.parametrize("packed", [False, True])
def test_archives_of_other_writers(spark, tmp_path, packed):
    import gzip

    name = "a.warc.gz" if packed else "a.warc"
    (tmp_path / name).write_bytes(b"".join(gzip.compress(r) if packed else r for r in RECORDS))
    table = warc.read(spark, str(tmp_path))
    assert table.count() == len(RECORDS)
    got = {r["record"]: r for r in warc.payloads(table).collect()}
    assert set(got) == {f"urn:uuid:a{i}" for i in (2, 3, 4, 5, 6)}
    for key, payload in (("a2", PAGE), ("a3", b"\xff\xfe\x00bytes"), ("a4", b""), ("a6", b"")):
        r = got[f"urn:uuid:{key}"]
        assert (r["payload_bytes"], r["payload_digest"], r["page_id"]) == (len(payload), hashlib.sha1(payload).hexdigest(), None)
    assert got["urn:uuid:a2"]["url"] == "http://x.org/" and got["urn:uuid:a3"]["url"] == "http://x.org/b"
    assert (got["urn:uuid:a5"]["record_type"], got["urn:uuid:a5"]["payload_digest"]) == ("revisit", "ABCDEFGH234567")


def test_a_damaged_archive_raises(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"".join(RECORDS)[:-1] + RECORDS[2][:-20])
    with pytest.raises(Exception, match="lacks [0-9]+ bytes"):
        warc.payloads(warc.read(spark, str(tmp_path))).collect()


def test_segments_of_other_writers(spark, tmp_path):
    first = foreign("response", "s1", b"one ", ["WARC-Segment-Number: 1"])
    second = foreign("continuation", "s2", b"two", ["WARC-Segment-Number: 2", "WARC-Segment-Origin-ID: <urn:uuid:s1>", "WARC-Segment-Total-Length: 7"])
    (tmp_path / "a.warc").write_bytes(second + first)
    (r,) = warc.payloads(warc.read(spark, str(tmp_path))).collect()
    assert (r["payload_bytes"], r["payload_digest"]) == (7, hashlib.sha1(b"one two").hexdigest())
