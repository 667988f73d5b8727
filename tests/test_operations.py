"""Reports, sessions, caches."""

import datetime
import hashlib
import json
import random

import pytest
from helpers import value
from pyspark.sql import functions as F

from lectern.functions.text import python_float
from lectern.operators import reuse, runs, sessions
from lectern.sources import files

EVENTS = "run_id int, seq long, bucket string, stage string, message string, detail map<string,string>, ts timestamp"


def event(run, seq, bucket, minute=0):
    return (run, seq, bucket, "s", f"[s] {bucket}", {"i": "1"}, datetime.datetime(2024, 1, 1, 0, minute))


def test_report(table):
    events = table(EVENTS, *[event(1, i, b, 9 - i) for i, b in enumerate(runs.BUCKETS)], event(2, 0, "cache_hits"), event(2, 1, "repairs"))
    known = table("run_id int, error string", (1, None), (2, None), (3, "boom"), (4, None))
    assert {tuple(r) for r in runs.bucket_counts(events).collect()} == {(1, 1, 1, 1, 1, 1), (2, 0, 0, 0, 1, 1)}
    assert {r.run_id: r.status for r in runs.run_status(events, known).collect()} == {1: "degraded", 2: "success", 3: "error", 4: "success"}
    # Latest recorded first in time here: warnings follow the clock.
    assert [r.bucket for r in runs.warnings(events).orderBy("position").collect()] == ["skipped_frames", "fallbacks", "failed_segments"]
    pages = runs.report_pages(events, known, page_events=2, max_rows=3).collect()
    assert sorted((r.run_id, r.page) for r in pages) == [(1, 0), (1, 1), (1, 2), (2, 0), (3, 0), (4, 0)]
    assert sum(len(r[b]) for r in pages for b in runs.BUCKETS) == 7


def test_sessions(table):
    s = table("id int, title string, thread_id string, created_at long, updated_at long", (1, "a", None, 0, 5), (2, None, "t", 60, 90))
    m = table(
        "id long, session_id int, role string, content string, tool_calls string, reasoning string, created_at long",
        (1, 1, "user", "x", '{"a":1}', "", 3), (2, 1, "assistant", "y", "broken", None, 1),
    )
    assert {r.id: r.message_count for r in sessions.listing(s, m).collect()} == {1: 2, 2: 0}
    assert [(r.id, r.position) for r in sessions.newest_first(s).collect()] == [(2, 1), (1, 2)]
    assert [(r.role, r.position) for r in sessions.messages_by_role(m.withColumn("role", F.expr("'r' || id"))).collect()][0][1] == 1
    pages = {(r.id, r.page): r for r in sessions.export(s, m, page_messages=1, max_rows=1).collect()}
    assert set(pages) == {(1, 0), (1, 1), (2, 0)}
    first, second = pages[1, 0].messages[0], pages[1, 1].messages[0]
    assert (first.role, first.tool_calls, second.created_at) == ("assistant", None, "1970-01-01T00:00:03")
    assert second.tool_calls.toPython() == {"a": 1}
    left, kept, gone = sessions.delete(s, m, s.where("id = 1").select("id"))
    assert [r.id for r in left.collect()] == [2] and kept.count() == 0
    assert [tuple(r) for r in gone.collect()] == [(1, 2)]
    everything = sessions.delete(s, m)
    assert everything[0].count() == everything[1].count() == 0
    assert {tuple(r) for r in everything[2].collect()} == {(1, 2), (2, 0)}


def short(text):
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def test_config_hash(spark):
    config = {
        "mode": "keyframe", "asr_provider": "", "asr_model": "", "heuristic_scene_threshold": 0.4,
        "heuristic_similarity_threshold": 0.95, "heuristic_max_frames": 200,
    }
    got = value(spark, reuse.config_hash(F.lit("keyframe"), scene=F.lit(0.4), similarity=F.lit(0.95), max_frames=F.lit(200)))
    assert got == short(json.dumps(config, sort_keys=True))


def test_config_hash_of_odd_names_and_numbers(spark):
    for name, scene, similarity in (
        ("转写 \U0001f600 \x7f\x00\n\t\b\f\r\"\\/", 1e-05, 1e22), ("", 0.1 + 0.2, 1.5e-10), ("é", 1e16, 123456789012345.6),
        ("a", 9.999999999999999e15, 5e-324), ("b", -0.0, -1.25), ("c", 1e-4, 1.7976931348623157e308), ("d", 100.0, 2e-3), ("e", float("inf"), 1 / 3),
    ):
        config = {
            "mode": "keyframe", "asr_provider": name, "asr_model": name, "heuristic_scene_threshold": scene,
            "heuristic_similarity_threshold": similarity, "heuristic_max_frames": 7,
        }
        got = value(spark, reuse.config_hash(F.lit("keyframe"), F.lit(name), F.lit(name), F.lit(scene), F.lit(similarity), F.lit(7)))
        assert got == short(json.dumps(config, sort_keys=True)), (name, scene, similarity)


def test_numbers_print_as_in_python(spark):
    rng = random.Random(2)
    numbers = [rng.uniform(-1, 1) * 10.0 ** rng.randint(-30, 30) for _ in range(500)] + [round(rng.uniform(0, 1000), 3) for _ in range(200)]
    got = spark.createDataFrame([(x,) for x in numbers], "x double").select(python_float(F.col("x")).alias("s")).collect()
    assert [r.s for r in got] == [repr(x) for x in numbers]


def test_export_prints_values_and_microseconds(spark, table):
    s = table("id long, title string, thread_id string, created_at double, updated_at double", (1, "t", None, 1.75, 2.0))
    m = table(
        "id long, session_id long, role string, content string, tool_calls string, reasoning string, created_at double",
        (5, 1, "user", "hi", '{"call": [1, {"x": null}]}', "broken", 1.000001), (6, 1, "user", "yo", "", '"text"', 1.5),
    )
    row = json.loads(sessions.export(s, m).toJSON().first())
    assert row["created_at"] == "1970-01-01T00:00:01.750000" and row["updated_at"] == "1970-01-01T00:00:02"
    first, second = row["messages"]
    assert first["tool_calls"] == {"call": [1, {"x": None}]} and "reasoning" not in first and second["reasoning"] == "text"
    assert (first["created_at"], second["created_at"]) == ("1970-01-01T00:00:01.000001", "1970-01-01T00:00:01.500000")


ROW = (
    "video_id int, mode string, input_sha string, input_size long, subtitle_sha string, subtitle_size long, "
    "config_hash string, frames_digest string"
)


def test_manifests(table):
    base = ("k", "i", 5, None, None, "c", None)
    stored = table(
        ROW, (1, *base), (2, *base[:-1], "d1"), (3, *base[:-1], "d1"), (4, *base[:-1], "d1"), (5, *base), (6, *base),
    )
    now = table(
        ROW, (1, *base), (2, *base), (3, *base[:-1], "d2"), (4, "k", "other", 5, None, None, "c", "d1"), (5, "k", "i", 5, "s", 1, "c", None), (7, *base),
    )
    got = {r.video_id: r.state for r in reuse.validate_manifests(stored, now).collect()}
    # With a digest on both sides the current one enters both keys.
    assert got == {1: "hit", 2: "hit", 3: "hit", 4: "stale", 5: "stale", 6: "orphan", 7: "new"}
    key = value(table("x int", (1,)).sparkSession, reuse.cache_key(F.lit("i"), F.lit(5), F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit("c"), F.lit("")))
    assert key == short("input:i:5|config:c")


def test_digest(table):
    frames = table("video_id int, frame_id long, path string, timestamp_sec double", (1, 2, "b", 1.5), (1, 1, "a", 0.25), (1, 3, "c", 9.0))
    lines = ["a|0.250000\n", "b|1.500000\n", "c|9.000000\n"]
    assert reuse.frames_digest(frames).first()["digest"] == short("".join(lines))


@pytest.mark.parametrize("large", [False, True])
def test_digest_of_long_videos(spark, large):
    frames = spark.range(300_000, numPartitions=7).select(
        F.expr("CASE WHEN id % 3 = 0 THEN 1 ELSE 2 END").alias("video_id"), F.col("id").alias("frame_id"),
        F.expr("CASE WHEN id = 7 THEN 'other' ELSE 'p' || id END").alias("path"),
        (F.col("id") * 7919 % 300_007 / 2.0).alias("timestamp_sec"),
    )
    got = {r.video_id: r.digest for r in reuse.frames_digest(frames, large=large).collect()}
    at = sorted((i * 7919 % 300_007 / 2.0, i) for i in range(300_000))
    for video in (1, 2):
        mine = [(t, i) for t, i in at if (i % 3 == 0) == (video == 1)]
        assert got[video] == short("".join(f"{'other' if i == 7 else f'p{i}'}|{t:.6f}\n" for t, i in mine))


def test_unreadable_manifests(spark, table, tmp_path):
    path = str(tmp_path / "m")
    files.write_manifests(table("video_id string, mode string, input_size long", ("1", "k", 5)), path)
    with open(f"{path}/broken.json", "w") as out:
        out.write('{"video_id": "2", "mode"\n[]\n{"other": 1}\n')
    assert [(r.video_id, r.input_size) for r in files.read_manifests(spark, path).collect()] == [("1", 5)]


def test_checkpoints(table):
    pieces = table("video_id int, index int, start_sec double", *[(1, i, i * 300.0) for i in range(4)])
    checkpoint = table(
        "video_id int, index int, status string, task_id string, result string",
        (1, 0, "done", "t0", "{}"), (1, 1, "submitted", "t1", None), (1, 2, "done", "t2", None),
    )
    assert {r["index"] for r in reuse.pending_pieces(pieces, checkpoint).collect()} == {1, 3}
    assert {r["index"] for r in reuse.restored_results(pieces, checkpoint).collect()} == {0}
    assert {r["index"] for r in reuse.pieces_to_poll(pieces, checkpoint).collect()} == {2}
    lost = reuse.missing_pieces(pieces, checkpoint.where("result IS NOT NULL")).collect()
    assert [tuple(r) for r in lost] == [(1, 4, 1, 3)]
