"""From segments and frames to chunk prompts, and from answers to documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import alignment, chunking, dedup, documents
from lectern.operators.ordering import MAX_GROUP_ROWS, any_large_group
from lectern.session import cut_lineage, hand_over


@dataclass
class Settings:
    segment_minutes: float = 10.0
    max_images_per_chunk: int = 20
    frame_match_tolerance: float = 2.0
    max_rows: int = MAX_GROUP_ROWS


@dataclass
class Inputs:
    """What ``prepare`` takes, and an event per fallback or skipped frame."""

    segments: DataFrame
    frames: DataFrame
    events: DataFrame


def complete_inputs(
    segments: DataFrame, texts: DataFrame, frames: DataFrame, similarity: float = 0.95, max_frames: int = 200
) -> Inputs:
    """Inputs of every video: approximate segments where there are no times, frames without near copies.

    ``texts`` is (video_id, text, duration_sec): a video without any timed segment gets its
    text spread over its duration. ``frames`` carry ``phash``: the earliest ``max_frames`` of
    a video are taken, and of these the ones unlike all kept before.
    """
    known = chunking.timed(segments).select("video_id").distinct()
    made = hand_over(chunking.synthesize_segments(texts.join(known, "video_id", "left_anti")), "synthetic")
    fallbacks = made.groupBy("video_id").agg(F.count(F.lit(1)).alias("segment_count")).select(
        "video_id", F.lit("fallbacks").alias("bucket"), F.lit("synthetic_segments").alias("stage"), "segment_count"
    )
    early = alignment.earliest_frames(frames, max_frames)
    skipped = dedup.unhashed(early).select("video_id", "bucket", "stage", "frame_id")
    columns = segments.columns
    return Inputs(
        segments=segments.unionByName(made.select(*[c for c in columns if c in made.columns]), allowMissingColumns=True),
        frames=dedup.deduplicate(early, similarity, max_frames),
        events=fallbacks.unionByName(skipped, allowMissingColumns=True),
    )


@dataclass
class Prepared:
    """Tables the text model's requests are made of."""

    chunks: DataFrame
    segments: DataFrame
    frames: DataFrame
    large: bool


def prepare(segments: DataFrame, frames: DataFrame, settings: Settings = Settings()) -> Prepared:
    """Chunk the transcripts, number the segments, place and cap the frames.

    Group sizes are checked once, on the key columns of both inputs: no later group of a
    video or of a chunk is larger. The second read of the segments chunks and numbers them;
    all three tables are handed over, as every later step reads them again.
    """
    large = any_large_group([chunking.timed(segments), frames], "video_id", settings.max_rows)
    if large:
        starts = cut_lineage(
            chunking.chunk_starts(segments, settings.segment_minutes, max_rows=settings.max_rows)
        )
        members = chunking.assign_chunks(segments, starts, settings.segment_minutes)
        numbered = hand_over(chunking.number_segments(members, large=True), "segments")
        chunks = chunking.chunk_offsets(chunking.chunk_table(numbered), large=True)
    else:
        full = hand_over(chunking.numbered_members(segments, settings.segment_minutes), "segments")
        numbered = full.select(*segments.columns, "chunk_index", "srt_id")
        chunks = chunking.first_rows(full)
    chunks = hand_over(chunks, "chunks")
    placed = alignment.distribute_frames(chunks, frames, large=large)
    capped = hand_over(alignment.cap_frames(placed, settings.max_images_per_chunk, large=large), "frames")
    return Prepared(chunks=chunks.drop("from_sec"), segments=numbered, frames=capped, large=large)


def chunk_summary(ready: Prepared) -> DataFrame:
    """Per chunk: its span, its segments, and the frames it was given."""
    counts = ready.frames.groupBy("video_id", "chunk_index").agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.count_if("matched").alias("n_matched"),
        F.min("timestamp_sec").alias("first_frame_sec"),
        F.max("timestamp_sec").alias("last_frame_sec"),
    )
    return (
        ready.chunks.join(counts, ["video_id", "chunk_index"], "left")
        .na.fill(0, ["n_frames", "n_matched"])
    )


def assemble(
    ready: Prepared,
    answers: DataFrame,
    evaluations: DataFrame,
    titles: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """(subtitle document, blog document) from answers and evaluations.

    ``answers`` is (video_id, chunk_index, blog_markdown) with global anchors;
    ``evaluations`` carries chunk-local ``srt_id`` and a ``seq``.
    """
    offsets = ready.chunks.select("video_id", "chunk_index", "segment_offset")
    keys = ["video_id", "chunk_index"]

    def globally(rows: DataFrame) -> DataFrame:
        return (
            rows.join(offsets, keys)
            .withColumn("srt_id", F.col("srt_id") + F.col("segment_offset"))
            .drop("segment_offset")
        )

    judged = globally(evaluations)
    subtitles = documents.subtitle_document(globally(ready.segments), judged, titles, large=ready.large)
    blog = documents.blog_document(answers, judged, titles, large=ready.large)
    return subtitles, blog
