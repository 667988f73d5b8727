"""WARC archives."""

import random

import plain
import pytest

from pyspark.sql import functions as F

from lectern.llm import warc
from lectern.session import scratch_path

rng = random.Random(31)
LONG = "é中a" * 9_000
PAGES = [
    (1, "http://a.example/1", "<p>same</p>"), (2, None, "<p>same</p>"), (7, "http://a.example/\r\nX: 1", "<p>same</p>"),
    (3, "u", None), (4, "u", ""), (5, "u", LONG), (6, "u", LONG + "x"), (8, "u", "WARC/1.1\r\n\r\n0\r\n\r\n"),
    (None, "u", "alone"), (None, "u", "<p>same</p>"), (9, "u", "퟿𝄞" * 5_000), (10, "u", plain.sentence(rng, 9_000)),
]
SMALL = warc.Layout(segment_bytes=1_000, chunk_bytes=300, records_per_file=5)


@pytest.fixture
def pages(spark):
    return lambda rows=PAGES: spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.mark.parametrize("layout", [SMALL, warc.Layout(), warc.Layout(revisit_bytes=5)])
def test_round_trip(spark, pages, layout):
    path = scratch_path(spark, "warc")
    warc.write(pages(), path, layout)
    rows = {(r["page_id"], r["payload_digest"]): r for r in warc.read(spark, path).collect()}
    assert len(rows) == len(PAGES)
    for page_id, url, html in PAGES:
        payload = (html or "").encode()
        row = rows[page_id, warc.payload_digest(payload)]
        same = [p for p, _, h in PAGES if (h or "").encode() == payload and p is not None]
        keeper = max(same, default=None)
        revisit = len(same) + (page_id is None) > 1 and keeper != page_id and len(payload) >= layout.revisit_bytes
        assert row["record_type"] == ("revisit" if revisit else "response")
        assert row["refers_to"] == (keeper if revisit else None) and row["problem"] is None
        assert row["payload_bytes"] == len(payload) and (revisit or row["payload"] == payload)
        if url is None or "\r" not in url:
            assert row["url"] == url


def test_segments_are_written(spark, pages):
    path = scratch_path(spark, "warc")
    warc.write(pages(), path, SMALL)
    parts = warc.parsed(spark, path).where("kind = 'continuation'").collect()
    assert len(parts) > 50 and all(len(p["block"]) <= 1_003 for p in parts)


def segments(n=4):
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"payload" * 40, 50)
    size = -(-len(block) // n)
    parts = [block[i : i + size] for i in range(0, len(block), size)]
    return [(i, len(block) if i == len(parts) else None, p) for i, p in enumerate(parts, 1)]


def test_damage_is_named():
    digest = "sha1:" + warc.payload_digest(b"payload" * 40)
    good = segments()
    assert warc.whole("response", good[::-1], digest)[0] == b"payload" * 40
    last = good[-1]
    cases = {
        "missing or repeated segment": [good[:1] + good[2:], good + good[1:2], good[1:]],
        "missing last segment": [good[:-1]],
        "wrong total length": [[*good[:-1], (last[0], last[1] + 1, last[2])]],
        "broken framing": [[*good[:-1], (last[0], last[1] - 5, last[2][:-5])]],
    }
    for problem, records in cases.items():
        for record in records:
            assert warc.whole("response", record, digest) == (None, None, None, problem)
    assert warc.whole("response", good, "sha1:" + warc.payload_digest(b""))[3] == "wrong digest"


def test_framing():
    for text in ["", "a", "é" * 1000, "0\r\n\r\n"]:
        assert warc.dechunked(warc.chunked(text.encode(), 7)) == text.encode()
    for bad in [b"", b"5\r\nabc\r\n", b"zz\r\n\r\n", b"-1\r\n\r\n", b"3\r\nabc\r\n"]:
        assert warc.dechunked(bad) is None


def test_edge_tables(spark, pages):
    path = scratch_path(spark, "warc")
    warc.write(pages([]).withColumn("digest", F.lit("mine")), path)
    assert warc.read(spark, path).count() == 0
    twice = scratch_path(spark, "warc")
    warc.write(pages([(1, "u", "x"), (1, "u", "x")]), twice)
    assert [r["record_type"] for r in warc.read(spark, twice).collect()] == ["response"] * 2
