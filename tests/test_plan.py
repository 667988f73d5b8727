"""The whole way with stand-in models: documents, retries, retakes, isolated failures."""

import json
import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lectern.functions import model_output
from lectern.plans.illustrated import Models, illustrate
from lectern.plans.lecture import Settings, complete_inputs, prepare

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(model_output)


def text_model(batches):
    """Polishes a chunk: reuses its first picture, asks for a far new capture.

    Chunk 1 is right only when asked to repair (that prompt shows no pictures);
    video 2 always fails.
    """
    for b in batches:
        out = []
        for video, chunk, prompt in zip(b["video_id"], b["chunk_index"], b["prompt"]):
            pictures = re.findall(r"!\[picture \d+ @ ([\d.]+)s\]\((.*?)\)", prompt)
            if video == 2 or (chunk == 1 and "<RAW>" not in prompt):
                out.append("sorry")
                continue
            requests, blog = [], f"## Chunk {chunk}"
            if pictures:
                at, path = pictures[0]
                blog += f"\n\n[[FRAME:a1@{at}]]"
                requests.append({"anchor_id": "a1", "srt_id": 1, "timestamp": float(at), "request_type": "reuse", "source_frame_path": path})
            blog += "\n\n[[FRAME:a2@9999.5]]"
            requests.append({"anchor_id": "a2", "srt_id": 2, "timestamp": 9999.5, "request_type": "new_capture", "source_frame_path": None})
            out.append("Here:\n" + json.dumps({"blog_markdown": blog, "frame_requests": requests}))
        yield b.assign(response=out)[["video_id", "chunk_index", "response"]]


def vision_model(batches):
    """Keeps pictures; wants new captures once more; leaves one of several out at first."""
    for b in batches:
        out = []
        for prompt in b["prompt"]:
            parts = json.loads(prompt)
            paths = [p["path"] for p in parts if p["type"] == "image"]
            names = re.findall(r"\[\[FRAME:(\w+)@", prompt)
            listed = [
                {"anchor_id": n.split("_")[-1], "keep_image": True, "caption": f"cap {n}",
                 "retake": "precise" in p, "retake_timestamp": 42.0}
                for n, p in zip(names, paths)
            ]
            out.append(json.dumps({"decisions": listed[:1] if len(listed) > 1 else listed}))
        yield b.assign(response=out)[["video_id", "batch", "response"]]


@pytest.fixture
def ready(table):
    segments = table(
        "video_id int, seq long, text string, start double, `end` double",
        *[(v, i, f"line {i}", i * 40.0, i * 40.0 + 30) for v in (1, 2) for i in range(4)],
    )
    frames = table(
        "video_id int, frame_id long, path string, timestamp_sec double",
        *[(v, i, f"tmp/f{v}_{i}.jpg", i * 30.0 + 1) for v in (1, 2) for i in range(4)],
    )
    return prepare(segments, frames, Settings(segment_minutes=1.0))


def models(**options):
    return Models(text=text_model, vision=vision_model, text_template="Go:\n{chunk_text}\n", vision_intro="Judge.", **options)


def test_documents(ready, table):
    titles = table("video_id int, title string", (1, "One"), (2, "Two"))
    out = illustrate(ready, titles, models(grab=lambda rows: rows))
    blog = {r.video_id: r.text for r in out.blog.collect()}
    assert blog[1] == (
        "# One\n\n## Chunk 0\n\n![图](src/f1_0.jpg)\n\n> *cap c0_a1*\n\n![图](src/c0_a2_retake_002_42.000.jpg)\n\n> *cap c0_a2*\n\n"
        "## Chunk 1\n\n![图](src/c1_a2_retake_002_42.000.jpg)\n\n> *cap c1_a2*\n"
    )
    assert blog[2] == "# Two\n"
    # The failing video loses only its own chunks.
    assert {(r.video_id, r.chunk_index) for r in out.failed_chunks.collect()} == {(2, 0), (2, 1)}
    assert out.failed_anchors.count() == 0 and out.captures.count() == 0
    subtitles = {r.video_id: r.text for r in out.subtitles.collect()}
    assert subtitles[1].count("![图]") == 3 and "> 3. **00:01:20 - 00:01:50**  \n> line 2" in subtitles[1]
    assert subtitles[2].count("![图]") == 0 and subtitles[2].count("> line") == 4
    log = [(r.stage, r.parse_error) for r in out.log.where("video_id = 1").collect()]
    assert log.count(("text", "schema_mismatch")) == 1 and ("vision", None) in log


def test_without_a_grabber(ready, table):
    titles = table("video_id int, title string", (1, "One"))
    out = illustrate(ready, titles, models())
    assert {(r.anchor_id, r.timestamp) for r in out.captures.collect()} == {("c0_a2", 9999.5), ("c1_a2", 9999.5)}
    assert {r.anchor_id: r.keep_image for r in out.evaluations.collect()} == {"c0_a1": True}
    assert "[[FRAME" not in out.blog.where(F.col("video_id") == 1).first()["text"]


def test_retakes_that_never_come(ready, table):
    titles = table("video_id int, title string", (1, "One"))
    out = illustrate(ready, titles, models(grab=lambda rows: rows.limit(0) if "round" in rows.columns else rows))
    got = {r.anchor_id: r.outcome for r in out.evaluations.collect()}
    assert got == {"c0_a1": "kept", "c0_a2": "unserved", "c1_a2": "unserved"}
    assert {(r.anchor_id, r["round"], r.timestamp) for r in out.captures.collect()} == {("c0_a2", 1, 42.0), ("c1_a2", 1, 42.0)}


def test_inputs_without_times_and_with_near_copies(table):
    segments = table(
        "video_id int, seq long, text string, start double, `end` double",
        (1, 0, "timed", 0.0, 5.0), (1, 1, "not timed", None, None), (2, 0, "untimed", None, None),
    )
    texts = table("video_id int, text string, duration_sec double", (1, "unused", 9.0), (2, "ab\n\n cdef ", 6.0), (3, " \n", 6.0), (4, "x", 0.0))
    frames = table(
        "video_id int, frame_id long, path string, timestamp_sec double, phash long",
        (1, 1, "a", 0.0, 0), (1, 2, "b", 1.0, 1), (1, 3, "c", 2.0, -1), (1, 4, "late", 3.0, 77), (2, 5, "d", 0.0, None),
    )
    got = complete_inputs(segments, texts, frames, 0.95, 3)
    rows = {(r.video_id, r.seq, r.text): (r.start, r.end) for r in got.segments.where("start IS NOT NULL").collect()}
    assert rows == {(1, 0, "timed"): (0.0, 5.0), (2, 0, "ab"): (0.0, 2.0), (2, 1, "cdef"): (2.0, 6.0), (4, 0, "x"): (0.0, 4.5)}
    assert got.segments.count() == 3 + 3
    assert {r.frame_id for r in got.frames.collect()} == {1, 3, 5}
    events = {(r.video_id, r.bucket, r.segment_count, r.frame_id) for r in got.events.collect()}
    assert events == {(2, "fallbacks", 2, None), (4, "fallbacks", 1, None), (2, "skipped_frames", None, 5)}
    ready = prepare(got.segments, got.frames.drop("phash"), Settings(segment_minutes=1.0))
    assert {(r.video_id, r.n_segments) for r in ready.chunks.collect()} == {(1, 1), (2, 2), (4, 1)}
