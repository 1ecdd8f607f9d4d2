"""WARC archives as a chunked record table.

A page's payload becomes rows (record identifier, chunk number, block) of at most ``chunk_bytes``
bytes. The first chunk is a ``response`` record, later ones are ``continuation`` records with
WARC-Segment-Number and WARC-Segment-Origin-ID, the last of which gives the total length: segmentation as the
WARC 1.1 standard describes it. Each row carries the SHA-1 state of the payload so far, so neither
side ever joins the chunks of a payload. Payloads of at least ``least_bytes`` bytes that occur more
than once are written once; the others are ``revisit`` records.

Spark's text writer and reader move the records: the string that opens a record is the separator
between rows, so archives can be read in splits. Where a payload contains it, a chunk ends inside,
which keeps every row, and every byte, apart.

Archives of other writers are read as well: WARC/1.0 or 1.1, any record identifiers, one gzip member a record or a
file, HTTP headers in front of payloads. Their payloads are not cut where they hold the separator; such
a record, like any whose block is shorter than its header says, raises when its payload is asked for.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.functions.sizes import broadcast_if_small
from tallymart.llm import frames

LEAST_BYTES = 1000
CHUNK_BYTES = 1 << 16

# Fixed values of the WARC format.
TOKEN = b"WARC/1."
MARK = "WARC/1."
VERSION = "1\r\n"
LINE_END = "\r\n"
RESPONSE = "response"
REVISIT = "revisit"
CONTINUATION = "continuation"
WARCINFO = "warcinfo"
PAYLOADS = ["response", "resource", "revisit", "conversion"]
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_ID = "null"
DATE = "2026-01-01T00:00:00Z"
HTML = "text/html; charset=utf-8"

_TOKEN = re.compile(re.escape(TOKEN))


def chunks(payload: bytes | memoryview, size: int) -> Iterator[memoryview]:
    """Views of at most ``size`` bytes that end between characters and never hold ``TOKEN``."""
    view, length = memoryview(payload), len(payload)
    if not length:
        yield view
    start = limit = 0
    while start < length:
        if start >= limit:
            found = _TOKEN.search(view, start)
            limit = length if found is None else found.end() - 1
        end = min(start + size, limit)
        while end < length and view[end] & 0xC0 == 0x80:
            end -= 1
        yield view[start:end]
        start = end


def _record(kind: str, record: str, fields: list[tuple[str, object]], block: bytes | memoryview) -> str:
    """A record without its opening line and without the last line end, which the writer adds."""
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record}>", f"WARC-Date: {DATE}"]
    lines += [f"{name}: {value}" for name, value in fields if value is not None]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""])
    return f"{head}{str(block, 'utf-8')}\r\n"


def _uri(url: str | None) -> str | None:
    """A URL as a header value: one line of visible characters."""
    return None if url is None else "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record_rows(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows (record, chunk, digest, value): one WARC record each, without its opening line.

    ``pages`` has page_id, url, html, record_type and refers_to. ``digest`` is the SHA-1 of the
    payload up to and with this chunk.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        described = False
        for batch in batches:
            for page, url, html, kind, refers in zip(*batch.columns, strict=True):
                if not described:
                    described = True
                    about = b"format: WARC File Format 1.1\r\n"
                    fields = [("Content-Type", "application/warc-fields")]
                    yield _batch((f"{NO_ID}:{part}-0", 1, hashlib.sha1(about).hexdigest(), _record(WARCINFO, f"{NO_ID}:{part}-0", fields, about)))
                made += 1
                page_id = NO_ID if page.as_py() is None else str(page.as_py())
                record = f"{page_id}:{part}-{made}"
                payload = memoryview(b"" if not html.is_valid else html.as_buffer())
                uri = [("WARC-Target-URI", _uri(url.as_py()))]
                if kind.as_py() == REVISIT:
                    digest = hashlib.sha1(payload).hexdigest()
                    fields = [
                        *uri, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers.as_py()}>"),
                        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", len(payload)),
                    ]
                    yield _batch((record, 1, digest, _record(REVISIT, record, fields, b"")))
                    continue
                state, number, held = hashlib.sha1(), 0, None
                for block in chunks(payload, chunk_bytes):
                    if held is not None:  # then the chunk before was not the last one
                        yield _batch(_chunk(record, number, uri, held, None))
                    state.update(block)
                    number, held = number + 1, (block, state.hexdigest())
                yield _batch(_chunk(record, number, uri, held, len(payload)))

    return pages.select("page_id", "url", "html", "record_type", "refers_to").mapInArrow(
        rows, "record string, chunk int, digest string, value string"
    )


def _chunk(record: str, number: int, uri: list, held: tuple, total: int | None) -> tuple:
    block, digest = held
    fields = [*uri, ("Content-Type", HTML), ("WARC-Running-Digest", f"sha1:{digest}"), ("WARC-Segment-Number", number)]
    if number > 1:
        fields.append(("WARC-Segment-Origin-ID", f"<urn:page:{record}>"))
    fields.append(("WARC-Segment-Total-Length", total))
    kind, name = (RESPONSE, record) if number == 1 else (CONTINUATION, f"{record}/{number}")
    return record, number, digest, _record(kind, name, fields, block)


def _batch(row: tuple) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["record", "chunk", "digest", "value"]
    )


def with_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Columns page_id, url, html, record_type, refers_to: which records repeat a payload.

    Of equal payloads the one with the largest id is the response. Rows that repeat this id are
    responses as well; a null id is smaller than any, so where all are null all are responses.
    """
    rows = pages.withColumns({
        "digest": F.sha1(F.coalesce("html", F.lit("")).cast("binary")),
        "size": F.octet_length(F.coalesce("html", F.lit(""))),
    })
    best = (
        pages.where(F.octet_length("html") >= least_bytes)
        .groupBy(F.sha1(F.col("html").cast("binary")).alias("same"))
        .agg(F.max("page_id").alias("top"), F.count("*").alias("copies"))
        .where("copies > 1")
        .select("same", "top")
    )
    rows = rows.join(broadcast_if_small(best), (F.col("digest") == F.col("same")) & (F.col("size") >= least_bytes), "left")
    repeats = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return rows.select(
        "page_id", "url", "html",
        F.when(repeats, REVISIT).otherwise(RESPONSE).alias("record_type"),
        F.when(repeats, F.col("top")).alias("refers_to"),
    )


def write(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = LEAST_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
    compression: str = "gzip",
) -> str:
    """Write one record a page as WARC files below ``path`` (one a task) and return the path.

    Null and empty payloads are records without a block; null URLs have no target. Ids are whole
    numbers; columns other than the three are left out. An empty table writes no record.
    """
    if chunk_bytes < 16:
        raise ValueError("chunk_bytes must be at least 16")
    frames.ready(pages)
    rows = pages.select(
        frames.col(pages, id_col).cast("long").alias("page_id"),
        frames.col(pages, url_col).alias("url"),
        frames.col(pages, html_col).alias("html"),
    )
    value = record_rows(with_revisits(rows, least_bytes), chunk_bytes).select(F.concat(F.lit(MARK + VERSION), "value").alias("value"))
    value.write.option("lineSep", LINE_END).option("compression", compression).text(path)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table: record, page_id, url, chunk, record_type, refers_to, digests, lengths and block.

    One row a WARC record of any type. ``block`` is binary and lacks the HTTP header that a record of type
    application/http has in front; ``missing`` is the number of bytes that the record's header promises and the file
    does not have. ``record`` is what identifies a payload: the record identifier's text. Records of this
    module's writer have a page_id, others have null. Revisit records alone have payload_digest (hex, or as
    the archive spells it) and payload_bytes, the last chunk of a segmented one alone the total length.
    """
    lines = spark.read.option("lineSep", MARK).text(path).where("length(value) > 2")
    cut = F.instr("value", "\r\n\r\n")
    # The version's digit and its line end come first; what has no header is no record.
    parts = lines.where(F.col("value").rlike(r"^[0-9]+\r\n") & (cut > 0)).select(
        F.col("value").substr(F.lit(1), cut).alias("head"),
        F.col("value").cast("binary").alias("raw"),
        F.octet_length(F.col("value").substr(F.lit(1), cut + 3)).alias("start"),
    )

    def field(name: str, pattern: str):
        found = F.regexp_extract("head", rf"(?i)(?:^|\n){name}:[ \t]*{pattern}[ \t]*\r", 1)
        return F.when(found != "", found)

    named = parts.select(
        "raw", "start",
        field("WARC-Type", "([a-z]+)").alias("kind"),
        F.coalesce(field("WARC-Segment-Origin-ID", "<([^>]*)>"), field("WARC-Record-ID", "<([^>]*)>")).alias("uri"),
        field("WARC-Target-URI", "<?([^\r>]*)>?").alias("url"),
        F.coalesce(field("WARC-Segment-Number", "([0-9]+)").cast("int"), F.lit(1)).alias("chunk"),
        field("WARC-Segment-Number", "([0-9]+)").isNull().alias("alone"),
        field("WARC-Refers-To", "<urn:page:([0-9-]*)>").cast("long").alias("refers_to"),
        field("WARC-Running-Digest", "sha1:([0-9a-f]+)").alias("running"),
        field("WARC-Payload-Digest", "(?:sha1:)?([0-9A-Za-z:+/=-]+)").alias("payload_digest"),
        field("WARC-Payload-Length", "([0-9]+)").cast("long").alias("payload_bytes"),
        field("WARC-Segment-Total-Length", "([0-9]+)").cast("long").alias("total"),
        field("Content-Length", "([0-9]+)").cast("int").alias("length"),
        (F.coalesce(field("Content-Type", "(application/http)[^\r]*"), F.lit("")) != "").alias("http"),
    )
    page = F.regexp_extract("uri", "^urn:page:(-?[0-9]+):", 1)
    body = F.substring("raw", F.col("start") + 1, F.coalesce("length", F.lit(0)))
    held = named.withColumn("body", body)
    return held.select(
        F.regexp_replace("uri", "^urn:page:", "").alias("record"),
        F.when(page != "", page).cast("long").alias("page_id"),
        "url",
        "chunk",
        F.when(F.col("kind") == CONTINUATION, RESPONSE).otherwise(F.col("kind")).alias("record_type"),
        "refers_to", "running", "payload_digest", "payload_bytes", "alone", "total",
        (F.coalesce("length", F.lit(1 << 30)) - F.octet_length("body")).alias("missing"),
        F.when(F.col("http"), _behind_http(F.col("body"))).otherwise(F.col("body")).alias("block"),
    ).withColumn("total", F.when(F.col("alone"), F.octet_length("block").cast("long")).otherwise(F.col("total"))).drop("alone")


def _behind_http(body: Column) -> Column:
    """What follows the first blank line of a block."""
    text = body.cast("string")
    end = F.instr(text, "\r\n\r\n")
    front = F.octet_length(F.substr(text, F.lit(1), end + 3))
    return F.when(end > 0, F.substring(body, front + 1, F.octet_length(body))).otherwise(body)


def payloads(table: DataFrame) -> DataFrame:
    """One row a payload of a chunk table: page_id, payload_bytes, payload_digest, record_type, refers_to, url, record.

    Lengths and digests are computed from the blocks, those of a revisit are its header's. Records of
    one chunk need no shuffle; the chunks of the others meet sorted by number and update one running SHA-1,
    which must agree with the digest each chunk carries. A missing or altered chunk raises, and
    so does a block shorter than its record's length. Other records (warcinfo, request, metadata) are no payloads; repeated
    records stay, a null page_id or url is returned as null.
    """
    frames.ready(table)
    table = table.where(F.col("record_type").isin(PAYLOADS))
    damaged = F.concat(F.lit("record "), F.coalesce("record", F.lit("without identifier")), F.lit(" lacks "), F.col("missing"), F.lit(" bytes"))
    table = table.withColumn("block", F.when(F.col("missing") > 0, F.raise_error(damaged).cast("binary")).otherwise(F.col("block")))
    single = (F.col("chunk") == 1) & F.col("total").isNotNull()
    revisit = F.col("record_type") == REVISIT
    whole = table.where(single | revisit).select(
        "page_id",
        F.when(revisit, F.col("payload_bytes")).otherwise(F.octet_length("block")).cast("long").alias("payload_bytes"),
        F.when(revisit, F.col("payload_digest")).otherwise(F.sha1("block")).alias("payload_digest"),
        "record_type",
        "refers_to",
        "url",
        "record",
    )

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record, page, url, number, state, size, total = None, None, None, 0, None, 0, None

        def done() -> pa.RecordBatch:
            if size != total:
                raise ValueError(f"record {record} has {size} of {total} bytes")
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([page], pa.int64()), pa.array([size], pa.int64()), pa.array([state.hexdigest()]),
                    pa.array([url], pa.string()), pa.array([record], pa.string()),
                ],
                ["page_id", "payload_bytes", "payload_digest", "url", "record"],
            )

        for batch in batches:
            for name, own, target, chunk, running, whole_size, block in zip(*batch.columns, strict=True):
                if name.as_py() != record:
                    if record is not None:
                        yield done()
                    record, page, url, number, state, size, total = name.as_py(), own.as_py(), target.as_py(), 0, hashlib.sha1(), 0, None
                number += 1
                data = block.as_buffer()
                state.update(data)
                size += len(data)
                told = running.as_py()  # archives of other writers have none
                if chunk.as_py() != number or (told is not None and state.hexdigest() != told):
                    raise ValueError(f"record {record}: chunk {number} is missing or altered")
                total = whole_size.as_py() if whole_size.as_py() is not None else total
        if record is not None:
            yield done()

    long = table.where(~single & ~revisit).select("record", "page_id", "url", "chunk", "running", "total", "block")
    met = long.repartition("record").sortWithinPartitions("record", "chunk")
    joined = met.mapInArrow(stream, "page_id long, payload_bytes long, payload_digest string, url string, record string").select(
        "page_id", "payload_bytes", "payload_digest", F.lit(RESPONSE).alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "url", "record"
    )
    return whole.union(joined)
