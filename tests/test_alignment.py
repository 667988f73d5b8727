"""Frame placement, with the tie and boundary rules."""

import random

import pytest

from lectern.operators import alignment as a
from lectern.operators.chunking import number_segments
from lectern.operators.documents import annotated_chunks

CHUNKS = "video_id int, chunk_index int, start_sec double, end_sec double, n_segments long"
FRAMES = "video_id int, frame_id long, path string, timestamp_sec double"
MEMBERS = "video_id int, chunk_index int, seq long, text string, start double, `end` double"


@pytest.mark.parametrize("max_rows", [10_000, 30])
def test_distribution_equals_loop(spark, max_rows):
    """Overlapping, empty and gapped chunks; the first covering chunk wins."""
    rng = random.Random(4)
    chunks = []
    for video in (1, 2):
        at = 0.0
        for i in range(25):
            at += rng.randrange(1, 40)
            chunks.append((video, i, at, at + rng.choice([-5.0, 0.0, 10.0, 30.0, 90.0]), 1))
    frames = [(rng.choice([1, 1, 2]), i, f"p{i}", float(rng.randrange(-10, 700))) for i in range(500)]
    got = a.distribute_frames(
        spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(frames, FRAMES), max_rows=max_rows
    ).collect()
    assert len(got) == 500
    for r in got:
        own = [c for c in chunks if c[0] == r.video_id]
        inside = [c for c in own if c[2] <= r.timestamp_sec < c[3]]
        want = inside[0] if inside else min(own, key=lambda c: abs(r.timestamp_sec - (c[2] + c[3]) / 2))
        assert (r.chunk_index, r.matched) == (want[1], bool(inside))


def test_cap_keeps_first(table):
    placed = table(FRAMES + ", chunk_index int", (1, 1, "a", 0.5, 0), (1, 2, "b", 1.5, 0))
    assert [r.path for r in a.cap_frames(placed, 1).collect()] == ["a"]
    assert a.cap_frames(placed, 2).count() == 2


def test_annotated_text(table):
    members = table(MEMBERS, (1, 0, 1, "first", 0.0, 5.0), (1, 0, 2, " second ", 5.0, 10.0))
    placed = table(FRAMES + ", chunk_index int", (1, 1, "src/a.jpg", 2.0, 0), (1, 2, "src/b.jpg", 7.0, 0))
    text = annotated_chunks(number_segments(members), placed).first()["text"]
    assert text == (
        "00:00:00,000 --> 00:00:05,000\nfirst\n\n![picture 1 @ 2.0s](src/a.jpg)\n\n"
        "00:00:05,000 --> 00:00:10,000\nsecond\n\n![picture 2 @ 7.0s](src/b.jpg)"
    )


@pytest.mark.parametrize("part_rows", [1, 2, 3])
def test_annotated_parts_make_the_whole(table, part_rows):
    members = table(MEMBERS, *[(1, 0, i, f" line {i} ", i * 5.0, i * 5.0 + 5) for i in range(4)])
    placed = table(FRAMES + ", chunk_index int", (1, 1, "src/a.jpg", 2.0, 0), (1, 2, "src/b.jpg", 7.0, 0))
    numbered = number_segments(members)
    parts = sorted((r["part"], r["text"]) for r in annotated_chunks(numbered, placed, part_rows=part_rows).collect())
    assert len(parts) == -(-6 // part_rows)
    assert "\n".join(t for _, t in parts) == annotated_chunks(numbered, placed).first()["text"]


def test_no_pick_is_an_error(table):
    placed = table(FRAMES + ", chunk_index int", (1, 1, "a", 0.5, 0))
    with pytest.raises(ValueError):
        a.cap_frames(placed, 0)


REQUESTS = (
    "video_id int, chunk_index int, anchor_id string, srt_id int, timestamp double, "
    "request_type string, source_frame_path string, reason string"
)


def test_anchor_binding(table):
    requests = table(
        REQUESTS,
        (1, 0, "a1", 1, 54.0, "new_capture", None, ""),
        (1, 0, "a2", 9, 60.0, "new_capture", None, ""),
        (1, 0, "a3", 1, 1.0, "reuse", "src/a.jpg", ""),
        (1, 0, "a4", 1, 1.0, "reuse", "src/none.jpg", ""),
        (1, 0, "a5", 1, 55.5, "new_capture", None, ""),
        (2, 0, "a1", 1, 54.0, "new_capture", None, ""),
    )
    placed = table(FRAMES + ", chunk_index int", (1, 1, "src/a.jpg", 53.5, 0))
    members = number_segments(table(MEMBERS, (1, 0, 1, " hello ", 0.0, 5.0)))
    bound, wanted, unknown = a.anchor_frames(requests, placed, members)
    got = {r.anchor_id: (r.frame_path, r.frame_time, r.subtitle_text) for r in bound.collect()}
    # The tolerance is inclusive; a bound anchor takes the frame's time.
    assert got == {
        "a1": ("src/a.jpg", 53.5, "hello"), "a3": ("src/a.jpg", 53.5, "hello"), "a5": ("src/a.jpg", 53.5, "hello"),
    }
    assert {(r.video_id, r.anchor_id, r.timestamp, r.target) for r in wanted.collect()} == {
        (1, "a2", 60.0, "precise/chunk_0/a2_60.000.jpg"), (2, "a1", 54.0, "precise/chunk_0/a1_54.000.jpg"),
    }
    assert [r.anchor_id for r in unknown.collect()] == ["a4"]


def test_nearest_segment_defaults_to_one(table):
    members = number_segments(table(MEMBERS, (1, 0, 1, "a", 0.0, 4.0), (1, 0, 2, "b", 4.0, 8.0), (1, 0, 3, "c", 9.0, None)))
    asked = table("video_id int, chunk_index int, timestamp double", (1, 0, 4.0), (1, 0, 9.0), (1, 1, 3.0))
    got = {(r.chunk_index, r.timestamp): r.nearest_srt_id for r in a.nearest_segment(members, asked).collect()}
    # 4.0 ties between segments 1 and 2; the open end of segment 3 puts its middle at 4.5.
    assert got == {(0, 4.0): 3, (0, 9.0): 2, (1, 3.0): 1}


def test_earliest_frames_limits_before_the_shuffle(spark, table):
    frames = table(FRAMES, *[(i % 3, i, "p", float(i)) for i in range(50)])
    out = a.earliest_frames(frames, 4)
    assert out.count() == 12
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
