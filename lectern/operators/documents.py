"""Putting ordered rows together into texts.

A text is returned in parts of at most ``part_rows`` pieces, numbered from 0.
Ordinary videos have one part; a very long one never has to fit in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.model_output import ANCHOR
from lectern.functions.text import (
    SPACES, display_end, display_start, hms, lines, lstrip, one_decimal, rstrip, srt_range, strip,
)
from lectern.operators.alignment import CHUNK, attach_to_segments
from lectern.operators.ordering import group_size, ordered, ordinal

PART_ROWS = 10_000

# Wording of the printed pieces.
PICTURE = ("![图](", ")")
CANDIDATE = ("![picture ", " @ ", "s](", ")")


def stitch(
    pieces: DataFrame,
    keys: list[str],
    order: list[str],
    text: str,
    separator: str,
    *,
    part_rows: int = PART_ROWS,
    **options,
) -> DataFrame:
    """Join the pieces of each key in order: (keys, part, n_parts, text).

    The parts of a key, joined by ``separator``, are its whole text.
    """
    specs = {"__pos": ordinal(), "__n": group_size()}
    placed = ordered(pieces.select(*keys, *order, text), keys, order, specs, **options)
    return (
        placed.withColumn("part", F.floor((F.col("__pos") - 1) / part_rows).cast("int"))
        .groupBy(*keys, "part")
        .agg(
            F.ceil(F.max("__n") / part_rows).cast("int").alias("n_parts"),
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct(F.col("__pos"), F.col(text).alias("t")))),
                    lambda p: p["t"],
                ),
                separator,
            ).alias("text"),
        )
    )


def srt_from_results(segments: DataFrame, **options) -> DataFrame:
    """SRT text of recognised segments; numbers count skipped rows, so gaps stay."""
    sized = {k: v for k, v in options.items() if k != "part_rows"}
    numbered = ordered(segments, ["video_id"], ["seq"], {"number": ordinal()}, **sized)
    cues = numbered.where(
        F.col("start").isNotNull() & F.col("end").isNotNull() & (strip(F.col("text")) != "")
    ).withColumn(
        "cue",
        F.concat_ws(
            "\n",
            F.col("number").cast("string"),
            srt_range(F.col("start"), F.col("end"), clamp=False),
            strip(F.col("text")),
        ),
    )
    return stitch(cues, ["video_id"], ["seq"], "cue", "\n\n", **options)


def srt_from_rows(segments: DataFrame, **options) -> DataFrame:
    """SRT text of subtitle rows, all of them numbered from 1."""
    sized = {k: v for k, v in options.items() if k != "part_rows"}
    numbered = ordered(segments, ["video_id"], ["seq"], {"number": ordinal()}, **sized)
    cues = numbered.withColumn(
        "cue",
        F.concat(
            F.col("number").cast("string"),
            F.lit("\n"),
            srt_range(F.col("start"), F.col("end")),
            F.lit("\n"),
            strip(F.col("text")),
            F.lit("\n"),
        ),
    )
    out = stitch(cues, ["video_id"], ["seq"], "cue", "\n", **options)
    return _finish(out)


def full_text(segments: DataFrame, separator: str, order: list[str] | None = None, **options) -> DataFrame:
    """All segment texts of a video: by space for recognised speech, by line for files."""
    return stitch(segments, ["video_id"], order or ["seq"], "text", separator, **options)


def annotated_chunks(
    numbered: DataFrame, placed: DataFrame, *, part_rows: int = PART_ROWS, **options
) -> DataFrame:
    """Chunk text for the text model: cues, and frames after their nearest cue.

    Parts joined by line ends are the whole text, whatever ``part_rows``: only its outer
    ends are stripped.
    """
    cues = numbered.select(
        *CHUNK,
        "srt_id",
        F.lit(0.0).cast("double").alias("at"),
        F.lit(-1).cast("long").alias("frame_id"),
        F.concat(
            srt_range(display_start(F.col("start")), display_end(F.col("start"), F.col("end"))),
            F.lit("\n"),
            strip(F.coalesce("text", F.lit(""))),
            F.lit("\n"),
        ).alias("piece"),
    )
    attached = attach_to_segments(numbered, placed, **options)
    # Pictures are counted across the chunk in the order they are printed.
    pictures = ordered(
        attached, CHUNK, ["srt_id", "timestamp_sec", "frame_id"], {"__picture": ordinal()}, **options
    ).select(
        *CHUNK,
        "srt_id",
        F.col("timestamp_sec").alias("at"),
        "frame_id",
        F.concat(
            F.lit(CANDIDATE[0]), F.col("__picture").cast("string"), F.lit(CANDIDATE[1]),
            one_decimal(F.col("timestamp_sec")), F.lit(CANDIDATE[2]), F.col("path"),
            F.lit(CANDIDATE[3] + "\n"),
        ).alias("piece"),
    )
    # Cues sort before their pictures: frame times are never negative.
    rows = cues.withColumn("kind", F.lit(0)).unionByName(pictures.withColumn("kind", F.lit(1)))
    out = stitch(
        rows, CHUNK, ["srt_id", "kind", "at", "frame_id"], "piece", "\n", part_rows=part_rows, **options
    )
    text = F.when(F.col("part") == 0, lstrip(F.col("text"))).otherwise(F.col("text"))
    return out.withColumn("text", F.when(F.col("part") == F.col("n_parts") - 1, rstrip(text)).otherwise(text))


def picture_markdown(
    frame_path: Column, caption: Column, representation: Column, *, quoted: bool, prefix: str = "src/"
) -> Column:
    """A kept frame as Markdown, with its caption and transcribed text below."""
    image = F.concat(
        F.lit(PICTURE[0] + prefix), F.element_at(F.split(frame_path, "/"), -1), F.lit(PICTURE[1])
    )
    title, body = strip(F.coalesce(caption, F.lit(""))), strip(F.coalesce(representation, F.lit("")))
    none = F.array().cast("array<string>")
    head = F.when(title != "", F.array(F.concat(F.lit("*"), title, F.lit("*")))).otherwise(none)
    tail = F.when(body != "", lines(body)).otherwise(none)
    gap = F.when((title != "") & (body != ""), F.array(F.lit(""))).otherwise(none)
    notes = F.concat(head, gap, tail)
    if quoted:
        notes = F.transform(
            notes, lambda p: F.when(strip(p) == "", F.lit(">")).otherwise(F.concat(F.lit("> "), p))
        )
    return F.when(F.size(notes) == 0, image).otherwise(
        F.array_join(F.concat(F.array(image, F.lit("")), notes), "\n")
    )


def kept_pictures(evaluations: DataFrame) -> DataFrame:
    """The last evaluation per anchor, where it keeps the image.

    ``first_seq`` is the place of the anchor's first evaluation and fixes the
    order of pictures under one segment.
    """
    keys = ["video_id", "anchor_id"]
    rest = [c for c in evaluations.columns if c not in [*keys, "seq"]]
    return (
        evaluations.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), "seq").alias("row"), F.min("seq").alias("first_seq"))
        .select(*keys, "first_seq", "row.*")
        .where("keep_image")
    )


def _finish(parts: DataFrame) -> DataFrame:
    """End each text, in its last part, with exactly one line break."""
    trimmed = F.concat(F.rtrim("text", F.lit(SPACES)), F.lit("\n"))
    last = F.col("part") == F.col("n_parts") - 1
    return parts.withColumn("text", F.when(last, trimmed).otherwise(F.col("text")))


def subtitle_document(
    segments: DataFrame, evaluations: DataFrame, titles: DataFrame, **options
) -> DataFrame:
    """Subtitles as block quotes, each followed by its kept pictures.

    ``segments`` carries the video-wide 1-based ``srt_id``, as do ``evaluations``.
    """
    head = titles.select(
        "video_id", F.lit(0).cast("long").alias("srt_id"), F.lit(-1).cast("long").alias("sub"),
        F.concat(F.lit("# "), F.col("title"), F.lit("\n")).alias("piece"),
    )
    start, end = display_start(F.col("start")), display_end(F.col("start"), F.col("end"))
    body = segments.select(
        "video_id", F.col("srt_id").cast("long").alias("srt_id"), F.lit(-1).cast("long").alias("sub"),
        F.concat(
            F.lit("> "), F.col("srt_id").cast("string"), F.lit(". **"), hms(start), F.lit(" - "),
            hms(end), F.lit("**  \n> "), F.coalesce("text", F.lit("")), F.lit("\n"),
        ).alias("piece"),
    )
    pictures = (
        kept_pictures(evaluations)
        .join(segments.select("video_id", "srt_id"), ["video_id", "srt_id"], "left_semi")
        .select(
            "video_id", F.col("srt_id").cast("long").alias("srt_id"), F.col("first_seq").alias("sub"),
            F.concat(
                picture_markdown(
                    F.col("frame_path"), F.col("caption"), F.col("text_representation"), quoted=False
                ),
                F.lit("\n"),
            ).alias("piece"),
        )
    )
    rows = head.unionByName(body).unionByName(pictures)
    return _finish(stitch(rows, ["video_id"], ["srt_id", "sub"], "piece", "\n", **options))


def rendered_chunks(blogs: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Chunk Markdown with anchors replaced by their kept pictures, or by nothing."""
    body = strip(F.col("blog_markdown"))
    whole = F.lit("\\[\\[FRAME:[A-Za-z0-9_-]+@\\d+(?:\\.\\d+)?\\]\\]")
    ids = F.regexp_extract_all(body, F.lit(ANCHOR), 1)
    pieces = blogs.select(
        *CHUNK,
        ids.alias("ids"),
        F.posexplode(F.split(body, whole)).alias("pos", "piece"),
    ).select(*CHUNK, "pos", "piece", F.get("ids", F.col("pos")).alias("anchor_id"))
    shown = kept_pictures(evaluations).select(
        "video_id",
        "anchor_id",
        picture_markdown(
            F.col("frame_path"), F.col("caption"), F.col("text_representation"), quoted=True
        ).alias("picture"),
    )
    text = F.array_join(
        F.transform(
            F.array_sort(
                F.collect_list(
                    F.struct("pos", F.concat("piece", F.coalesce("picture", F.lit(""))).alias("t"))
                )
            ),
            lambda p: p["t"],
        ),
        "",
    )
    # The pieces of a chunk come from one text, so the groups stay small.
    return (
        pieces.join(shown, ["video_id", "anchor_id"], "left")
        .groupBy(*CHUNK)
        .agg(text.alias("text"))
        .withColumn("text", strip(F.regexp_replace("text", "\n{3,}", "\n\n")))
    )


def blog_document(
    blogs: DataFrame, evaluations: DataFrame, titles: DataFrame, **options
) -> DataFrame:
    """The chunks of a video in order, pictures in place of anchors."""
    head = titles.select(
        "video_id", F.lit(-1).cast("long").alias("chunk_index"),
        F.concat(F.lit("# "), F.col("title"), F.lit("\n")).alias("piece"),
    )
    rows = rendered_chunks(blogs, evaluations).select(
        "video_id", F.col("chunk_index").cast("long").alias("chunk_index"),
        F.concat("text", F.lit("\n")).alias("piece"),
    )
    return _finish(stitch(head.unionByName(rows), ["video_id"], ["chunk_index"], "piece", "\n", **options))


def chunk_totals(chunks: DataFrame) -> DataFrame:
    """Chunks per video, how many were not degraded, and each degraded index.

    One row per degraded chunk, or one with a null index. The degraded chunks are
    the probe side of the join, so a video with very many of them can be split.
    """
    totals = chunks.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("chunks_total"),
        F.count_if(~F.col("degraded")).alias("chunks_succeeded"),
    )
    failed = chunks.where("degraded").select("video_id", F.col("chunk_index").alias("failed_chunk"))
    clean = totals.where("chunks_total = chunks_succeeded")
    return failed.join(totals, "video_id").unionByName(clean, allowMissingColumns=True).select(
        "video_id", "chunks_total", "chunks_succeeded", "failed_chunk"
    )
