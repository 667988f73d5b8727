"""Greedy chunks against a plain loop, small and large groups alike."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import chunking as c

SCHEMA = "video_id int, seq long, text string, start double, `end` double"


def loop(starts, seconds):
    out, opened = {}, []
    for s in sorted(starts):
        if not opened or s - opened[-1] >= seconds:
            opened.append(s)
        out[s] = len(opened) - 1
    return out


@pytest.mark.parametrize("max_rows", [100_000, 40])
@pytest.mark.parametrize("minutes", [1.0, 0.1])
def test_greedy_chunks(spark, max_rows, minutes):
    rng = random.Random(3)
    rows = [
        (0 if i % 3 else rng.randrange(1, 9), i, "x", round(rng.random() * 900, 3) if i % 50 else None, None)
        for i in range(900)
    ]
    segs = spark.createDataFrame(rows, SCHEMA)
    starts = c.chunk_starts(segs, minutes, max_rows=max_rows)
    got = {(r.video_id, r.seq): r.chunk_index for r in c.assign_chunks(segs, starts, minutes).collect()}
    want = {}
    for video in range(9):
        places = loop({r[3] for r in rows if r[0] == video and r[3] is not None}, minutes * 60)
        want.update({(r[0], r[1]): places[r[3]] for r in rows if r[0] == video and r[3] is not None})
    assert got == want


def test_decimal_boundaries(spark):
    """Boundaries where start + N and start - N round differently."""
    rows = [(v, i, "x", round(v * 0.1 + i * 0.1, 1), None) for v in range(30) for i in range(120)]
    segs = spark.createDataFrame(rows, SCHEMA)
    for minutes in (0.005, 0.02):
        small = c.chunk_starts(segs, minutes, max_rows=1000)
        large = c.chunk_starts(segs, minutes, max_rows=10)
        assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
        per_video = {v: loop([r[3] for r in rows if r[0] == v], minutes * 60) for v in range(30)}
        members = c.assign_chunks(segs, small, minutes).collect()
        assert len(members) == len(rows)
        assert all(per_video[m.video_id][m.start] == m.chunk_index for m in members)


def test_two_far_segments_and_span(table):
    segs = table(SCHEMA, (1, 1, "a", 0.0, 5.0), (1, 2, "b", 10.0, 4.0), (1, 3, "c", 600.0, None), (2, 1, "n", None, 3.0))
    starts = c.chunk_starts(segs, 10)
    members = c.assign_chunks(segs, starts, 10)
    got = [tuple(r) for r in c.chunk_table(members).orderBy("chunk_index").collect()]
    # The end is the last segment's, not the largest, and falls back to its start.
    assert got == [(1, 0, 0.0, 4.0, 2), (1, 1, 600.0, 600.0, 1)]
    assert [tuple(r) for r in c.untimed_counts(segs).collect()] == [(2, 1, 1)]


def test_minutes_must_be_positive(table):
    with pytest.raises(ValueError):
        c.chunk_starts(table(SCHEMA, (1, 1, "a", 0.0, 5.0)), 0)


def test_split_plan(table):
    media = table("video_id int, duration_sec double", (1, 5400.0), (2, 600.0), (3, 1500.0), (4, 0.0))
    long = c.split_plan(media, 1800.0).where("video_id = 1").orderBy("index").collect()
    assert [(r["index"], r.start_sec, r.piece_sec) for r in long] == [(0, 0.0, 1800.0), (1, 1800.0, 1800.0), (2, 3600.0, 1800.0)]
    assert c.split_plan(media, 1800.0).where("video_id = 2").count() == 1
    last = c.split_plan(media, 600.0).where("video_id = 3").orderBy("index").collect()[-1]
    assert (last["index"], last.start_sec, last.piece_sec) == (2, 1200.0, 300.0)
    assert [r.timestamp_sec for r in c.interval_grid(media.where("video_id = 2")).collect()] == [30.0 * i for i in range(20)]


def test_synthetic_segments(table):
    texts = table("video_id int, text string, duration_sec double", (1, "ab\n\n abcdef ", 8.0), (2, "x\ny", 0.0))
    got = {(r.video_id, r.seq): (r.text, r.start, r.end) for r in c.synthesize_segments(texts).collect()}
    assert got == {
        (1, 0): ("ab", 0.0, 2.0), (1, 1): ("abcdef", 2.0, 8.0),
        (2, 0): ("x", 0.0, 4.5), (2, 1): ("y", 4.5, 9.0),
    }


def test_synthetic_segments_of_long_texts(table):
    rng = random.Random(3)
    texts = ["\n".join("x" * rng.randint(0, 90) for _ in range(n)) for n in (1, 255, 256, 257, 3000)] + [None, "", " \n "]
    rows = [(i, text, rng.choice([0.0, None, 1234.56, -1.0])) for i, text in enumerate(texts)]
    df = c.synthesize_segments(table("video_id int, text string, duration_sec double", *rows))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    got = {(r.video_id, r.seq): (r.text, r.start, r.end) for r in df.collect()}
    want = {}
    for video, text, duration in rows:
        lines = [x for x in (text or "").split("\n") if x.strip()]
        duration = duration if duration and duration > 0 else max(4.5, len(lines) * 4.5)
        total, starts = sum(map(len, lines)), [0.0]
        for line in lines[:-1]:
            starts.append(starts[-1] + duration * len(line) / total)
        for k, line in enumerate(lines):
            end = starts[k + 1] if k + 1 < len(lines) else duration
            want[video, k] = (line, starts[k], max(starts[k] + 0.1, end))
    assert got == want


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 50, 51])
@pytest.mark.parametrize("k", [1, 2, 3, 4, 7, 20, 50])
def test_even_positions(spark, n, k):
    rows = spark.range(n).where(c.even_positions(F.col("id"), F.lit(n), k)).collect()
    if n <= k:
        want = set(range(n))
    elif k == 1:
        want = {0}
    else:
        want = {round(i * (n - 1) / (k - 1)) for i in range(k)}
    assert {r.id for r in rows} == want
