"""Web archives: writing records with segments, revisits and chunked transfer, and reading them back.

Layout. An archive is a folder of files of concatenated WARC/1.1 records. A record whose block is longer
than ``segment_bytes`` is cut: the first piece keeps the record's type, the others are ``continuation``
records that name the first piece's id, carry their number and, the last one, the total length. A block
is an HTTP response with chunked transfer coding; a revisit's block is the HTTP header alone.

Cases. A null html is an empty payload; a null url has no target URI; a null page_id stays null and never
is what others refer to, so in a group of nothing but null ids every record is a response. Rows repeated
whole give a record each. Of equal payloads of at least ``min_revisit_bytes`` the largest page_id is the
response. An empty table gives an archive without records and no rows. Columns other than page_id, url and
html are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.llm.common import materialise, record_batch

PAGE_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("segments", pa.int32()), ("intact", pa.bool_())])

CRLF = b"\r\n"
#: Ends each record; the text writer puts it after each row.
RECORD_END = "\r\n\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"

RAW_SCHEMA = (
    "record_id string, origin_id string, segment int, total_length long, record_type string, page_id long, "
    "refers_to long, url string, declared_digest string, declared_bytes long, block binary"
)
RAW_ARROW = pa.schema([("record_id", pa.string()), ("origin_id", pa.string()), ("segment", pa.int32()), ("total_length", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("url", pa.string()), ("declared_digest", pa.string()), ("declared_bytes", pa.int64()), ("block", pa.binary())])
PAGE_SCHEMA = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
    "segments int, intact boolean"
)


def chunked(payload: bytes, size: int) -> bytes:
    """HTTP/1.1 chunked transfer coding."""
    out = []
    for i in range(0, len(payload), size):
        piece = payload[i : i + size]
        out += [b"%x\r\n" % len(piece), piece, CRLF]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunk(body: bytes) -> bytes | None:
    """The payload of a chunked body, or None where the framing is broken. Extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        at = end + 2
        if size == 0:
            return b"".join(out)
        if size < 0 or body[at + size : at + size + 2] != CRLF:
            return None
        out.append(body[at : at + size])
        at += size + 2


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{k}: {v}\r\n" for k, v in headers if v is not None]
    return f"WARC/1.1\r\n{''.join(lines)}Content-Length: {len(block)}\r\n\r\n".encode() + block


def page_records(row: dict, record_id: str, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of one page, without the ends: one, or a first segment and its continuations."""
    revisit = row["record_type"] == "revisit"
    block = HTTP_HEAD if revisit else HTTP_HEAD + chunked(row["payload"], chunk_bytes)
    uri = None if row["url"] is None else quote(row["url"], safe="!#$%&'()*+,/:;=?@[]~")
    about = [("WARC-Page-Id", row["page_id"]), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"), ("WARC-Payload-Length", row["payload_bytes"]), ("WARC-Date", "2024-01-01T00:00:00Z")]
    if revisit:
        about += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{row['refers_to']}>")]
    kind = [("Content-Type", "application/http; msgtype=response")]
    pieces = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{record_id}>")]
    if len(pieces) == 1:
        yield _record(head + about + kind, block)
        return
    yield _record([*head, *about, ("WARC-Segment-Number", 1), *kind], pieces[0])
    for n, piece in enumerate(pieces[1:], 2):
        last = len(block) if n == len(pieces) else None
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{record_id}:{n}>"), ("WARC-Segment-Origin-ID", f"<{record_id}>"), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", last)], piece)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of a file, led by the lengths, never by the content."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        stop = start + int(headers["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where its length says")
        yield headers, data[start:stop]
        at = stop + 4


def classify(pages: DataFrame, min_revisit_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to for each page.

    The responses of large enough payloads are a grouped maximum, combined before the shuffle and written
    out, so that the join back meets two plain exchanges and a payload that a third of all pages share is
    split by the adaptive skew join.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    base = base.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    kept = base.where(F.col("payload_bytes") >= min_revisit_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1 and kept is not null").drop("n")
    joined = base.join(materialise(kept, "responses"), "payload_digest", "left")
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("kept")).alias("refers_to"))


def write_archive(pages: DataFrame, path: str, *, segment_bytes: int = 16_384, chunk_bytes: int = 4_096, bundle_bytes: int = 1 << 20, bundles_per_file: int = 16, min_revisit_bytes: int = 1000) -> None:
    """Write a record per page below ``path``, as files of at most about bundle_bytes x bundles_per_file."""

    def bundles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0
        end = RECORD_END.encode()

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"value": pa.array([end.join(held)], pa.binary())})

        for batch in batches:
            for row in batch.to_pylist():
                for record in page_records(row, f"urn:record:{part}-{n}", segment_bytes, chunk_bytes):
                    held.append(record)
                    size += len(record)
                    if size >= bundle_bytes:
                        yield emit()
                        held, size = [], 0
                n += 1
        if held:
            yield emit()

    out = classify(pages, min_revisit_bytes).mapInArrow(bundles, "value binary")
    # The text writer stores the bytes of a string as they are.
    out.select(F.col("value").cast("string")).write.option("lineSep", RECORD_END).option("maxRecordsPerFile", bundles_per_file).text(path)


def _urn(value: str | None) -> str | None:
    return None if value is None else value.strip("<>")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archive below ``path``, as RAW_SCHEMA; origin_id is its own id for first segments."""

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda h, k: int(h[k]) if k in h else None
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for h, block in parse_records(content.as_py()):
                    refers = _urn(h.get("warc-refers-to"))
                    rows.append((_urn(h["warc-record-id"]), _urn(h.get("warc-segment-origin-id", h["warc-record-id"])), number(h, "warc-segment-number"), number(h, "warc-segment-total-length"), h["warc-type"], number(h, "warc-page-id"), int(refers.rpartition(":")[2]) if refers else None, h.get("warc-target-uri"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None, number(h, "warc-payload-length"), block))
                    size += len(block)
                    if size > 4 << 20:
                        yield record_batch(rows, RAW_ARROW)
                        rows, size = [], 0
                if rows:
                    yield record_batch(rows, RAW_ARROW)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, RAW_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """A row per page (PAGE_SCHEMA): whole records go straight on, cut ones are grouped by origin id.

    ``intact`` holds if the segments are numbered 1..n, their lengths add up to the stated total, the
    chunked framing decodes and the payload has the stated digest; a broken record's payload columns
    are null.
    """
    first = ("record_type", "page_id", "refers_to", "url", "declared_digest", "declared_bytes")
    whole = records.where("segment is null").select(*first, F.array(F.struct(F.lit(1).alias("segment"), F.lit(None).cast("long").alias("total_length"), "block")).alias("pieces"))
    cut = records.where("segment is not null").groupBy("origin_id").agg(*[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in first], F.sort_array(F.collect_list(F.struct("segment", "total_length", "block"))).alias("pieces")).drop("origin_id")

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                pieces = row["pieces"]
                body = b"".join(p["block"] for p in pieces)
                total = pieces[-1]["total_length"]
                good = [p["segment"] for p in pieces] == list(range(1, len(pieces) + 1)) and (len(body) == total if len(pieces) > 1 else total is None)
                size = digest = None
                if good and row["record_type"] == "revisit":
                    size, digest = row["declared_bytes"], row["declared_digest"]
                elif good:
                    payload = dechunk(body[body.index(b"\r\n\r\n") + 4 :]) if b"\r\n\r\n" in body else None
                    good = payload is not None and hashlib.sha1(payload).hexdigest() == row["declared_digest"]
                    if good:
                        size, digest = len(payload), row["declared_digest"]
                rows.append((row["page_id"], row["url"], row["record_type"], row["refers_to"], size, digest, len(pieces), good))
            yield record_batch(rows, PAGE_ARROW)

    return whole.unionByName(cut).mapInArrow(decode, PAGE_SCHEMA)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    return assemble(read_records(spark, path))
