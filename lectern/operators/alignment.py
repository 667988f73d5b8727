"""Matching frames, segments, chunks and anchors by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import midpoint, repair_midpoint, strip
from lectern.operators.chunking import even_positions
from lectern.operators.ordering import group_size, nearest, ordered, ordinal, running_max, sweep

CHUNK = ["video_id", "chunk_index"]


def chunk_reach(chunks: DataFrame, **options) -> DataFrame:
    """The part of the timeline that each chunk wins, as disjoint intervals.

    Chunks may overlap, and the first chunk in order wins. Starts grow with the
    index, so chunk ``i`` wins from ``max(start_i, largest earlier end)`` to its
    own end, and nothing when an earlier chunk ends later. Chunk tables that carry
    ``from_sec`` already know it.
    """
    if "from_sec" not in chunks.columns:
        past = running_max(F.col("end_sec"), inclusive=False)
        chunks = ordered(chunks, ["video_id"], ["chunk_index"], {"__past": past}, **options).withColumn(
            "from_sec", F.greatest("start_sec", "__past")
        )
    return chunks.where("end_sec > from_sec").select("video_id", "chunk_index", "from_sec", "end_sec")


def frames_in_chunks(chunks: DataFrame, frames: DataFrame, **options) -> DataFrame:
    """Frames inside some chunk's ``[start_sec, end_sec)``; the first chunk wins."""
    swept = sweep(
        frames,
        "timestamp_sec",
        {"reach": (chunk_reach(chunks, **options), "from_sec", ["end_sec", "chunk_index"])},
        ["video_id"],
        **options,
    )
    return swept.where(F.col("timestamp_sec") < F.col("reach_prev.end_sec")).select(
        *frames.columns, F.col("reach_prev.chunk_index").alias("chunk_index")
    )


def distribute_frames(chunks: DataFrame, frames: DataFrame, **options) -> DataFrame:
    """Every frame with its chunk: the covering one, else the nearest midpoint.

    ``matched`` tells the two apart. Frames of videos without chunks drop out.
    Covering interval and nearest midpoints come from one sorted pass.
    """
    mids = chunks.groupBy(
        "video_id", ((F.col("start_sec") + F.col("end_sec")) / 2).alias("mid")
    ).agg(F.min("chunk_index").alias("chunk_index"))
    swept = sweep(
        frames,
        "timestamp_sec",
        {
            "reach": (chunk_reach(chunks, **options), "from_sec", ["end_sec", "chunk_index"]),
            "mid": (mids, "mid", ["chunk_index"]),
        },
        ["video_id"],
        **options,
    )

    def candidate(side: str):
        pt = F.col(f"mid_{side}")
        return F.when(
            pt.isNotNull(),
            F.struct(F.abs(F.col("timestamp_sec") - pt["t"]).alias("dist"), pt["chunk_index"].alias("chunk_index")),
        )

    inside = F.coalesce(F.col("timestamp_sec") < F.col("reach_prev.end_sec"), F.lit(False))
    near = F.least(candidate("prev"), candidate("next"))
    return swept.select(
        *frames.columns,
        F.when(inside, F.col("reach_prev.chunk_index")).otherwise(near["chunk_index"]).alias("chunk_index"),
        inside.alias("matched"),
    ).where("chunk_index IS NOT NULL")


def cap_frames(placed: DataFrame, k: int, **options) -> DataFrame:
    """At most ``k`` frames per chunk, evenly spread over its frames in time order."""
    specs = {"__pos": ordinal(), "__n": group_size()}
    numbered = ordered(placed, CHUNK, ["timestamp_sec", "frame_id"], specs, **options)
    return numbered.where(even_positions(F.col("__pos") - 1, F.col("__n"), k)).select(*placed.columns)


def attach_to_segments(numbered: DataFrame, placed: DataFrame, **options) -> DataFrame:
    """Frames with the nearest segment of their chunk, by midpoint.

    ``numbered`` carries ``srt_id``; equal distances go to the lower one.
    """
    segs = numbered.withColumn("__mid", midpoint(F.col("start"), F.col("end")))
    out = nearest(placed, "timestamp_sec", segs, "__mid", "srt_id", [], CHUNK, **options)
    return out.select(*placed.columns, F.col("near.rank").alias("srt_id")).where("srt_id IS NOT NULL")


def nearest_segment(numbered: DataFrame, times: DataFrame, at: str = "timestamp", **options) -> DataFrame:
    """For each time, the nearest segment number in its chunk; 1 for an empty chunk."""
    segs = numbered.withColumn("__mid", repair_midpoint(F.col("start"), F.col("end")))
    out = nearest(times, at, segs, "__mid", "srt_id", [], CHUNK, **options)
    return out.select(
        *times.columns, F.coalesce(F.col("near.rank"), F.lit(1)).cast("long").alias("nearest_srt_id")
    )


def bind_reused(requests: DataFrame, placed: DataFrame) -> DataFrame:
    """Reuse requests joined to the frame they name; ``frame_path`` is null if unknown."""
    first = placed.groupBy(*CHUNK, F.col("path").alias("source_frame_path")).agg(
        F.min_by("timestamp_sec", F.struct("timestamp_sec", "frame_id")).alias("frame_time")
    )
    return (
        requests.where("request_type = 'reuse'")
        .join(first, [*CHUNK, "source_frame_path"], "left")
        .select(
            *requests.columns,
            F.when(F.col("frame_time").isNotNull(), F.col("source_frame_path")).alias("frame_path"),
            F.col("frame_time"),
        )
    )


def bind_captures(requests: DataFrame, placed: DataFrame, tolerance: float = 2.0, **options) -> DataFrame:
    """New-capture requests with the nearest frame within ``tolerance`` seconds.

    The bound takes the frame's own time. Without such a frame both fields are
    null and the row belongs on the capture list.
    """
    wanted = requests.where("request_type = 'new_capture'")
    out = nearest(
        wanted, "timestamp", placed, "timestamp_sec", "frame_id", ["path", "timestamp_sec"], CHUNK, **options
    )
    close = F.coalesce(F.col("near.dist") <= tolerance, F.lit(False))
    return out.select(
        *requests.columns,
        F.when(close, F.col("near.path")).alias("frame_path"),
        F.when(close, F.col("near.timestamp_sec")).alias("frame_time"),
    )


def capture_requests(captures: DataFrame) -> DataFrame:
    """Work list of frames to grab, at the requested time."""
    return captures.where("frame_path IS NULL").select(
        *CHUNK,
        "anchor_id",
        "timestamp",
        F.format_string(
            "precise/chunk_%d/%s_%.3f.jpg", F.col("chunk_index"), F.col("anchor_id"), F.col("timestamp")
        ).alias("target"),
    )


def subtitle_of(requests: DataFrame, numbered: DataFrame) -> DataFrame:
    """Requests with the text of their 1-based segment; '' when out of range."""
    texts = numbered.select(*CHUNK, "srt_id", F.col("text").alias("__text"))
    return requests.join(texts, [*CHUNK, "srt_id"], "left").select(
        *requests.columns, strip(F.coalesce("__text", F.lit(""))).alias("subtitle_text")
    )


def anchor_frames(
    requests: DataFrame, placed: DataFrame, numbered: DataFrame, tolerance: float = 2.0, **options
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bound anchors, capture list, reuse requests that name an unknown frame)."""
    reused = bind_reused(requests, placed)
    captured = bind_captures(requests, placed, tolerance, **options)
    bound = reused.unionByName(captured).where("frame_path IS NOT NULL")
    return (
        subtitle_of(bound, numbered),
        capture_requests(captured),
        reused.where("frame_path IS NULL"),
    )


def earliest_frames(frames: DataFrame, max_frames: int) -> DataFrame:
    """The first ``max_frames`` frames of each video by time.

    Spark turns the rank filter into a per-task limit before the shuffle, so a
    large video sends at most ``max_frames`` rows per task.
    """
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy("timestamp_sec", "frame_id"))
    return frames.withColumn("__rank", rank).where(F.col("__rank") <= max_frames).drop("__rank")


def merge_frame_sources(scene: DataFrame, interval: DataFrame) -> DataFrame:
    """Scene and interval frames in one table, tagged by source."""
    return scene.withColumn("source", F.lit("scene")).unionByName(
        interval.withColumn("source", F.lit("interval"))
    )
