"""Chunking, alignment, counting: the driver's ``events`` as lectures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import alignment, chunking, documents
from lectern.operators.ordering import ordered, ordinal
from lectern.plans.lecture import Settings, chunk_summary, prepare
from workload import tables as t
from workload.sqlparts import query

SETTINGS = Settings(
    segment_minutes=t.SEGMENT_MINUTES,
    max_images_per_chunk=t.FRAMES_PER_CHUNK,
    frame_match_tolerance=t.TOLERANCE,
)


def _starts(spark, sf):
    return chunking.chunk_starts(t.segments(spark, sf), t.SEGMENT_MINUTES)


def _members(spark, sf):
    return chunking.assign_chunks(t.segments(spark, sf), _starts(spark, sf), t.SEGMENT_MINUTES)


def _chunks(spark, sf):
    return chunking.chunk_table(_members(spark, sf))


def _ready(spark, sf):
    return prepare(t.segments(spark, sf), t.frames(spark, sf), SETTINGS)


def frames_per_chunk(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_summary(_ready(spark, sf)).select(
        "video_id", "chunk_index", "start_sec", "end_sec", "n_segments", "segment_offset",
        "n_frames", "n_matched", "first_frame_sec", "last_frame_sec",
    )


def w1(spark, sf):
    return _members(spark, sf).select("video_id", "seq", "chunk_index")


def f31(spark, sf):
    return chunking.untimed_counts(t.segments(spark, sf))


def a3(spark, sf):
    return _chunks(spark, sf)


def w3(spark, sf):
    return chunking.chunk_offsets(_chunks(spark, sf)).select("video_id", "chunk_index", "segment_offset")


def w6(spark, sf):
    return chunking.number_segments(_members(spark, sf)).select("video_id", "chunk_index", "seq", "srt_id")


def j1(spark, sf):
    ready = _ready(spark, sf)
    return alignment.frames_in_chunks(ready.chunks, t.frames(spark, sf), large=ready.large).select(
        "video_id", "frame_id", "chunk_index"
    )


def j2(spark, sf):
    ready = _ready(spark, sf)
    return (
        alignment.distribute_frames(ready.chunks, t.frames(spark, sf), large=ready.large)
        .where("NOT matched")
        .select("video_id", "frame_id", "chunk_index")
    )


def w2(spark, sf):
    return _ready(spark, sf).frames.select("video_id", "frame_id", "chunk_index", "matched")


def j3(spark, sf):
    ready = _ready(spark, sf)
    return alignment.attach_to_segments(ready.segments, ready.frames, large=ready.large).select(
        "video_id", "chunk_index", "frame_id", "srt_id"
    )


def j4(spark, sf):
    ready = _ready(spark, sf)
    asked = t.requests(spark, sf, ready.segments)
    return alignment.nearest_segment(ready.segments, asked, large=ready.large).select(
        "video_id", "chunk_index", "anchor_id", "nearest_srt_id"
    )


def j5(spark, sf):
    ready = _ready(spark, sf)
    return alignment.bind_reused(t.requests(spark, sf, ready.segments), ready.frames).select(
        "video_id", "chunk_index", "anchor_id", "frame_path", "frame_time"
    )


def _captures(spark, sf):
    ready = _ready(spark, sf)
    asked = t.requests(spark, sf, ready.segments)
    return alignment.bind_captures(asked, ready.frames, t.TOLERANCE, large=ready.large)


def j6(spark, sf):
    return _captures(spark, sf).where("frame_path IS NOT NULL").select(
        "video_id", "chunk_index", "anchor_id", "frame_path", "frame_time"
    )


def j7(spark, sf):
    return alignment.capture_requests(_captures(spark, sf)).select(
        "video_id", "chunk_index", "anchor_id", "timestamp"
    )


def j8(spark, sf):
    ready = _ready(spark, sf)
    return alignment.subtitle_of(t.requests(spark, sf, ready.segments), ready.segments).select(
        "video_id", "chunk_index", "anchor_id", "subtitle_text"
    )


def t1(spark, sf):
    return ordered(
        chunking.timed(t.segments(spark, sf)), ["video_id"], ["start", "end", "seq"], {"position": ordinal()}
    ).select("video_id", "seq", "position")


def t2(spark, sf):
    return alignment.earliest_frames(t.frames(spark, sf), 25).select("video_id", "frame_id")


def u1(spark, sf):
    f = t.frames(spark, sf)
    plain = f.drop("source")
    return alignment.merge_frame_sources(
        plain.where("frame_id % 2 = 0"), plain.where("frame_id % 2 = 1")
    ).select("video_id", "frame_id", "timestamp_sec", "source")


def f26(spark, sf):
    ready = _ready(spark, sf)
    return documents.annotated_chunks(ready.segments, ready.frames, large=ready.large).select(
        "video_id", "chunk_index", "part", "text"
    )


NEAR_SEGMENT = """
SELECT * EXCLUDE (r) FROM (
  SELECT {cols}, m.srt_id AS {name},
         row_number() OVER (PARTITION BY {key} ORDER BY abs({mid} - {at}), m.srt_id) AS r
  FROM {table} x JOIN members m ON m.video_id = x.video_id AND m.chunk_index = x.chunk_index) WHERE r = 1"""
MID = "(m.start + coalesce(nullif(m.\"end\", 0), m.start)) / 2e0"
REPAIR_MID = "(m.start + coalesce(m.\"end\", 0)) / 2e0"
J3 = NEAR_SEGMENT.format(
    cols="x.video_id, x.chunk_index, x.frame_id", name="srt_id", key="x.video_id, x.chunk_index, x.frame_id",
    mid=MID, at="x.timestamp_sec", table="capped",
)
J6 = f"""
SELECT * EXCLUDE (r) FROM (
  SELECT q.video_id, q.chunk_index, q.anchor_id, q.timestamp, f.path AS frame_path, f.timestamp_sec AS frame_time,
         abs(f.timestamp_sec - q.timestamp) AS dist,
         row_number() OVER (PARTITION BY q.video_id, q.chunk_index, q.anchor_id
                            ORDER BY abs(f.timestamp_sec - q.timestamp), f.frame_id) AS r
  FROM requests q LEFT JOIN capped f ON q.video_id = f.video_id AND q.chunk_index = f.chunk_index
  WHERE q.request_type = 'new_capture') WHERE r = 1"""

def srt_sql(x: str) -> str:
    ms = f"CAST(round_even(({x}) * 1000, 0) AS BIGINT)"
    return (
        f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"
    )


F26 = f"""
SELECT video_id, chunk_index, 0 AS part,
       trim(string_agg(piece, chr(10) ORDER BY srt_id, kind, moment, frame_id), E' \\n') AS text
FROM (
  SELECT video_id, chunk_index, srt_id, 0 AS kind, 0e0 AS moment, -1 AS frame_id,
         {srt_sql('start')} || ' --> ' || {srt_sql('coalesce(nullif("end", 0), start)')}
           || chr(10) || trim(text) || chr(10) AS piece
  FROM members
  UNION ALL
  SELECT video_id, chunk_index, srt_id, 1, timestamp_sec, frame_id,
         '![picture ' || row_number() OVER (PARTITION BY video_id, chunk_index
                                           ORDER BY srt_id, timestamp_sec, frame_id)
         || ' @ ' || printf('%.1f', timestamp_sec) || 's](' || path || ')' || chr(10)
  FROM (SELECT a.*, f.timestamp_sec, f.path FROM ({J3}) a
        JOIN capped f ON a.video_id = f.video_id AND a.frame_id = f.frame_id))
GROUP BY video_id, chunk_index"""

QUERIES = {
    "frames_per_chunk": (frames_per_chunk, query("""
SELECT c.*, coalesce(f.n_frames, 0) AS n_frames, coalesce(f.n_matched, 0) AS n_matched,
       f.first_frame_sec, f.last_frame_sec,
       CAST(coalesce(sum(c.n_segments) OVER (PARTITION BY c.video_id ORDER BY c.chunk_index
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS segment_offset
FROM chunks c LEFT JOIN (
  SELECT video_id, chunk_index, count(*) AS n_frames, count(*) FILTER (WHERE matched) AS n_matched,
         min(timestamp_sec) AS first_frame_sec, max(timestamp_sec) AS last_frame_sec
  FROM capped GROUP BY video_id, chunk_index) f
ON c.video_id = f.video_id AND c.chunk_index = f.chunk_index""")),
    "w1_greedy_chunks": (w1, query("SELECT video_id, seq, chunk_index FROM members")),
    "f31_untimed_segments": (f31, """
SELECT user_id AS video_id, count(*) FILTER (WHERE event_id % 97 = 13) AS skipped_count, count(*) AS total_count
FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE event_id % 97 = 13) > 0"""),
    "a3_chunk_spans": (a3, query("SELECT * FROM chunks")),
    "w3_segment_offsets": (w3, query("""
SELECT video_id, chunk_index, CAST(coalesce(sum(n_segments) OVER (PARTITION BY video_id ORDER BY chunk_index
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS segment_offset FROM chunks""")),
    "w6_segment_numbers": (w6, query("SELECT video_id, chunk_index, seq, srt_id FROM members")),
    "j1_frames_in_chunks": (j1, query("SELECT video_id, frame_id, chunk_index FROM placed WHERE matched")),
    "j2_nearest_chunk": (j2, query("SELECT video_id, frame_id, chunk_index FROM placed WHERE NOT matched")),
    "w2_even_frames": (w2, query("SELECT video_id, frame_id, chunk_index, matched FROM capped")),
    "j3_frame_to_segment": (j3, query(J3)),
    "j4_time_to_segment": (j4, query(NEAR_SEGMENT.format(
        cols="x.video_id, x.chunk_index, x.anchor_id", name="nearest_srt_id",
        key="x.video_id, x.chunk_index, x.anchor_id", mid=REPAIR_MID, at="x.timestamp", table="requests"))),
    "j5_reused_frames": (j5, query("""
SELECT q.video_id, q.chunk_index, q.anchor_id, f.path AS frame_path, f.timestamp_sec AS frame_time
FROM requests q LEFT JOIN capped f ON q.video_id = f.video_id AND q.chunk_index = f.chunk_index
 AND q.source_frame_path = f.path WHERE q.request_type = 'reuse'""")),
    "j6_frames_in_tolerance": (j6, query(f"""
SELECT video_id, chunk_index, anchor_id, frame_path, frame_time FROM ({J6}) WHERE dist <= {t.TOLERANCE}""")),
    "j7_frames_to_capture": (j7, query(f"""
SELECT video_id, chunk_index, anchor_id, timestamp FROM ({J6}) WHERE dist IS NULL OR dist > {t.TOLERANCE}""")),
    "j8_anchor_subtitles": (j8, query("""
SELECT q.video_id, q.chunk_index, q.anchor_id, coalesce(trim(m.text), '') AS subtitle_text
FROM requests q LEFT JOIN members m ON q.video_id = m.video_id AND q.chunk_index = m.chunk_index
 AND q.srt_id = m.srt_id""")),
    "t1_segment_order": (t1, query("""
SELECT video_id, seq, row_number() OVER (PARTITION BY video_id ORDER BY start, "end" NULLS FIRST, seq) AS position
FROM segs WHERE start IS NOT NULL""")),
    "t2_earliest_frames": (t2, query("""
SELECT video_id, frame_id FROM frames
QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY timestamp_sec, frame_id) <= 25""")),
    "u1_frame_sources": (u1, query("SELECT video_id, frame_id, timestamp_sec, source FROM frames")),
    "f26_annotated_chunks": (f26, query(F26)),
}
