"""WARC archives: write records in segments, read them back whole.

A response is an HTTP message whose body has chunked framing. A block longer than
``segment_bytes`` is written as a first record and continuation records, which name it by
``WARC-Segment-Origin-ID`` and count from 2; the last one has the total length. Reading
parses every file by content lengths, groups continuation records with their origin,
orders them by segment number, verifies number and length, decodes the framing and
checks the digest. Records of one segment are never shuffled.

Blocks are cut between characters, so every record is text and Spark's text writer puts
it into the shared folder; files have a bounded number of records of bounded size.

Defined results: a null or empty html is an empty payload; null page ids and urls are
left out of the record and come back null; repeated rows are records of their own; rows
that share both the payload and its largest page id are all responses; a record with a
missing or repeated segment, a wrong length, broken framing or a wrong digest comes back
with its ``problem`` named and no payload; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import common
from lectern.session import scratch_path


@dataclass(frozen=True)
class Layout:
    """Sizes in bytes: segments, HTTP chunks, and the smallest payload worth a revisit."""

    segment_bytes: int = 32_768
    chunk_bytes: int = 8_192
    records_per_file: int = 512
    revisit_bytes: int = 0


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def cut(data: bytes, size: int) -> Iterator[bytes]:
    """Pieces of about ``size`` bytes that end between UTF-8 characters."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        yield data[at:end]
        at = end


def chunked(payload: bytes, size: int) -> bytes:
    """HTTP chunked transfer framing."""
    return b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in cut(payload, size)) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None when the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0 or body[end + 2 + size : end + 4 + size] != b"\r\n":
            return None
        if size == 0:
            return b"".join(parts)
        parts.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def _record(kind: str, record_id: str, block: bytes, **fields: object) -> str:
    """One record without its last line end, which the text writer adds."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{record_id}>", "WARC-Date": "2024-01-01T00:00:00Z"}
    head |= {name.replace("_", "-"): value for name, value in fields.items() if value is not None}
    lines = "".join(f"{name}: {value}\r\n" for name, value in head.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n" + block.decode("utf-8", "surrogatepass") + "\r\n"


def _field(value: str | None) -> str | None:
    """A header value: no line ends, no outer blanks."""
    return None if value is None else "".join(c if c >= " " else f"%{ord(c):02X}" for c in value).strip()


def records(page_id, url, html: str, digest: str, size: int, refers_to, layout: Layout) -> Iterator[str]:
    """All records of one page."""
    record_id = str(uuid.uuid4())
    fields = {
        "WARC_Target_URI": _field(url), "Page_ID": page_id, "WARC_Payload_Digest": f"sha1:{digest}",
        "Content_Type": "application/http;msgtype=response",
    }
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: %d\r\n\r\n" % size
        yield _record(
            "revisit", record_id, block, **fields, Refers_To_Page_ID=refers_to,
            WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        )
        return
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    block = head + chunked(html.encode("utf-8", "surrogatepass"), layout.chunk_bytes)
    parts = list(cut(block, layout.segment_bytes))
    if len(parts) == 1:
        yield _record("response", record_id, block, **fields)
        return
    for number, part in enumerate(parts, 1):
        total = len(block) if number == len(parts) else None
        if number == 1:
            yield _record("response", record_id, part, **fields, WARC_Segment_Number=1)
        else:
            yield _record(
                "continuation", str(uuid.uuid4()), part, WARC_Segment_Number=number,
                WARC_Segment_Origin_ID=f"<urn:uuid:{record_id}>", WARC_Segment_Total_Length=total,
            )


#: Repeated payloads (about 60 bytes each) up to which they are sent to all executors.
BROADCAST_ROWS = 200_000
#: Characters of records that are handed to Spark at a time.
_HANDED = 2_000_000


def plan(pages: DataFrame, layout: Layout) -> DataFrame:
    """Pages with payload size, hex digest and ``refers_to``.

    Only payloads that occur more than once are joined back, without a shuffle of the pages
    while they are few.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    sized = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), payload.alias("__llm_payload"))
    sized = sized.select(
        "page_id", "url", "html", F.octet_length("__llm_payload").cast("long").alias("size"),
        F.sha1("__llm_payload").alias("digest"),
    )
    several = (
        sized.where(F.col("size") >= layout.revisit_bytes)
        .groupBy("digest", "size").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1")
        .drop("n")
    )
    several = common.stage(several, "repeated")
    if several.count() <= BROADCAST_ROWS:
        several = F.broadcast(several)
    keeper = F.when(F.col("keeper") != F.col("page_id"), F.col("keeper")).when(
        F.col("page_id").isNull(), F.col("keeper")
    )
    return sized.join(several, ["digest", "size"], "left").withColumn("refers_to", keeper).drop("keeper")


def write(pages: DataFrame, path: str, layout: Layout | None = None) -> None:
    """Write all pages as WARC records into files under ``path``."""
    layout = layout or Layout()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, size = [], 0
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
                for line in records(
                    row["page_id"], row["url"], row["html"], digest, row["size"], row["refers_to"], layout
                ):
                    lines.append(line)
                    size += len(line)
                if size > _HANDED or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
                    lines, size = [], 0

    (
        plan(pages, layout).mapInArrow(run, "value string")
        .write.option("lineSep", "\r\n").option("maxRecordsPerFile", layout.records_per_file).text(path)
    )


_PARSED = (
    "kind string, record_id string, origin_id string, number int, total long, page_id long, url string,"
    " refers_to long, digest string, block binary"
)


def parse(content: bytes) -> Iterator[dict]:
    """The records of one file, cut by their content lengths."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode("utf-8", "surrogatepass").split("\r\n")[1:]
        head = {name.lower(): value for name, _, value in (line.partition(": ") for line in lines)}
        size = int(head["content-length"])
        yield {**head, "block": content[end + 4 : end + 4 + size]}
        at = end + 4 + size + 4


def parsed(spark: SparkSession, path: str) -> DataFrame:
    """All records under ``path``; a file is one row while it is parsed, which its size bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def number(head, name):
            return int(head[name]) if name in head else None

        for batch in batches:
            for content in batch.column(0):
                rows = [
                    {
                        "kind": r["warc-type"], "record_id": r["warc-record-id"],
                        "origin_id": r.get("warc-segment-origin-id"), "number": number(r, "warc-segment-number"),
                        "total": number(r, "warc-segment-total-length"), "page_id": number(r, "page-id"),
                        "url": r.get("warc-target-uri"), "refers_to": number(r, "refers-to-page-id"),
                        "digest": r.get("warc-payload-digest"), "block": r["block"],
                    }
                    for r in parse(content.as_buffer().to_pybytes())
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _PARSED)


_SCHEMA = pa.schema(
    [
        ("kind", pa.string()), ("record_id", pa.string()), ("origin_id", pa.string()), ("number", pa.int32()),
        ("total", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()),
        ("digest", pa.string()), ("block", pa.binary()),
    ]
)

_WHOLE = (
    "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long,"
    " payload_digest string, problem string"
)
_WHOLE_SCHEMA = pa.schema(
    [
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("problem", pa.string()),
    ]
)


_SEGMENT = pa.schema(
    [
        ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()), ("kind", pa.string()),
        ("record_id", pa.string()), ("origin_id", pa.string()), ("number", pa.int32()), ("total", pa.int64()),
        ("digest", pa.string()), ("block", pa.binary()),
    ]
)
_SEGMENT_TYPES = "kind string, record_id string, origin_id string, number int, total long, digest string, block binary"
_BOTH = pa.schema([*_WHOLE_SCHEMA, *[f for f in _SEGMENT if f.name not in _WHOLE_SCHEMA.names]])


def whole(kind: str, segments: list[tuple[int, int | None, bytes]], digest: str | None) -> tuple:
    """Payload, its size and digest, and what is wrong with the record, if anything."""
    segments = sorted(segments, key=lambda s: s[0])
    block = b"".join(s[2] for s in segments)
    if [s[0] for s in segments] != list(range(1, len(segments) + 1)):
        return None, None, None, "missing or repeated segment"
    if len(segments) > 1 and segments[-1][1] is None:
        return None, None, None, "missing last segment"
    if len(segments) > 1 and segments[-1][1] != len(block):
        return None, None, None, "wrong total length"
    head, _, body = block.partition(b"\r\n\r\n")
    named = (digest or "").removeprefix("sha1:") or None
    fields = dict(line.lower().split(b": ", 1) for line in head.split(b"\r\n")[1:] if b": " in line)
    if kind == "revisit":
        return None, int(fields.get(b"content-length", b"0")), named, None
    payload = dechunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body
    if payload is None:
        return None, None, None, "broken framing"
    if payload_digest(payload) != named:
        return None, None, None, "wrong digest"
    return payload, len(payload), named, None


def read(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """All response and revisit records under ``path``, put together and verified.

    Records of one segment are finished where they are parsed; the others wait in a table
    with the parsed rows and are grouped, a group being one payload.
    """

    def finished(rows: list[dict]) -> list[dict]:
        out = []
        for r in rows:
            parts = [(p["number"], p["total"], p["block"]) for p in r["parts"]]
            payload, size, digest, problem = whole(r["kind"], parts, r["digest"])
            out.append(
                {
                    "page_id": r["page_id"], "url": r["url"], "record_type": r["kind"],
                    "refers_to": r["refers_to"], "payload": payload if keep_payload else None,
                    "payload_bytes": size, "payload_digest": digest, "problem": problem,
                }
            )
        return out

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            single = [r for r in rows if r["number"] is None]
            done = finished([{**r, "parts": [{"number": 1, "total": None, "block": r["block"]}]} for r in single])
            rest = [{name: r[name] for name in _SEGMENT.names} for r in rows if r["number"] is not None]
            for part, schema in ((done, _WHOLE_SCHEMA), (rest, _SEGMENT)):
                table = pa.Table.from_pylist(part, schema=schema)
                columns = [
                    table[f.name].combine_chunks() if f.name in table.column_names else pa.nulls(len(part), f.type)
                    for f in _BOTH
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=_BOTH)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist(finished(batch.to_pylist()), schema=_WHOLE_SCHEMA)

    rows = common.stage(parsed(spark, path).mapInArrow(first, f"{_WHOLE}, {_SEGMENT_TYPES}"), "records")
    head = ["kind", "page_id", "url", "refers_to", "digest"]
    origin = F.col("kind") != "continuation"
    several = (
        rows.where("number IS NOT NULL")
        .groupBy(F.coalesce("origin_id", "record_id").alias("origin"))
        .agg(
            *[F.max(F.when(origin, F.col(c))).alias(c) for c in head],
            F.collect_list(F.struct("number", "total", "block")).alias("parts"),
        )
        .select(*head, "parts")
    )
    single = rows.where("number IS NULL").select(*_WHOLE_SCHEMA.names)
    return single.unionByName(several.mapInArrow(second, _WHOLE))


def op2(spark, sf) -> DataFrame:
    path = scratch_path(spark, "warc")
    write(common.documents(spark, sf, "pages"), path)
    return read(spark, path, keep_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem"
    )


_BITS = "list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', (strpos('0123456789abcdef', sha1(html)[i]) - 1) * 4 + 1, 4))"

SQL = f"""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
bits AS (SELECT page_id, html, array_to_string({_BITS}, '') AS b, octet_length(encode(html))::BIGINT AS size FROM payloads),
digests AS (
  SELECT page_id, size, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (1 + 16 * b[5 * k + 1]::INT + 8 * b[5 * k + 2]::INT + 4 * b[5 * k + 3]::INT + 2 * b[5 * k + 4]::INT + b[5 * k + 5]::INT)::BIGINT,
    1)), '') AS digest
  FROM bits),
kept AS (SELECT *, max(page_id) OVER (PARTITION BY digest, size) AS keeper FROM digests)
SELECT page_id, size AS payload_bytes, digest AS payload_digest,
       CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to, NULL::VARCHAR AS problem
FROM kept"""


# Functions of this module travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
