"""Reusing earlier results: cache keys, manifests, recognition checkpoints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import json_ascii, python_float
from lectern.operators.ordering import MAX_GROUP_ROWS, has_large_group
from lectern.operators.streams import fold, fold_partitions

KEY_CHARS = 16
#: Lines of a frame digest that are joined to one piece.
PIECE_LINES = 4096


def short_hash(value: Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substr(F.sha2(value, 256), F.lit(1), F.lit(KEY_CHARS))


def content_hash(files: DataFrame) -> DataFrame:
    """(path, size, sha) of ``binaryFile`` rows."""
    return files.select(
        "path", F.col("length").alias("size"), short_hash(F.col("content")).alias("sha")
    )


def config_hash(
    mode: Column,
    provider: Column | None = None,
    model: Column | None = None,
    scene: Column | None = None,
    similarity: Column | None = None,
    max_frames: Column | None = None,
) -> Column:
    """Hash of the settings that a cache depends on, as JSON with sorted keys in ASCII."""

    def text(value: Column | None) -> Column:
        return json_ascii(F.coalesce(value, F.lit("")) if value is not None else F.lit(""))

    def number(value: Column | None) -> Column:
        return python_float(F.coalesce(value, F.lit(0.0)) if value is not None else F.lit(0.0))

    most = F.lit("0") if max_frames is None else F.coalesce(max_frames.cast("string"), F.lit("0"))
    return short_hash(
        F.concat(
            F.lit('{"asr_model": '), text(model),
            F.lit(', "asr_provider": '), text(provider),
            F.lit(', "heuristic_max_frames": '), most,
            F.lit(', "heuristic_scene_threshold": '), number(scene),
            F.lit(', "heuristic_similarity_threshold": '), number(similarity),
            F.lit(', "mode": '), text(mode), F.lit("}"),
        )
    )


def cache_key(
    input_sha: Column, input_size: Column, subtitle_sha: Column, subtitle_size: Column,
    config: Column, digest: Column,
) -> Column:
    """Key over the parts that are present."""

    def file_part(name: str, sha: Column, size: Column) -> Column:
        return F.concat(F.lit(f"{name}:"), sha, F.lit(":"), size.cast("string"))

    return short_hash(
        F.concat_ws(
            "|",
            file_part("input", input_sha, input_size),
            file_part("subtitle", subtitle_sha, subtitle_size),
            F.concat(F.lit("config:"), config),
            F.concat(F.lit("frames:"), F.nullif(digest, F.lit(""))),
        )
    )


class _Digest:
    """SHA-256 over the lines that come, or over joined ones."""

    def __init__(self) -> None:
        self.hash = hashlib.sha256()

    def take(self, at, frame_id, path) -> None:
        self.hash.update(_line(path, at))

    def end(self) -> Iterator[tuple]:
        yield (self.hash.hexdigest()[:KEY_CHARS],)


class _JoinedDigest(_Digest):
    def take(self, piece, lines) -> None:
        self.hash.update(lines)


class _Joined:
    """Lines in order as pieces of bounded size, numbered along all partitions."""

    def __init__(self) -> None:
        self.number, self.lines = TaskContext.get().partitionId() << 33, []

    def take(self, at, frame_id, path) -> Iterator[tuple]:
        self.lines.append(_line(path, at))
        if len(self.lines) >= PIECE_LINES:
            yield from self.end()

    def end(self) -> Iterator[tuple]:
        yield self.number, b"".join(self.lines)
        self.number, self.lines = self.number + 1, []


def _line(path: str | None, at: float | None) -> bytes:
    text = "null" if path is None else path
    return f"{text}|{'null' if at is None else format(at, '.6f')}\n".encode("utf-8", "surrogatepass")


def frames_digest(
    frames: DataFrame, *, large: bool | None = None, max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Digest over the lines of all frames of a video, in order of time and id.

    One hash state per video runs along its sorted rows. With a video of more than
    ``max_rows`` frames, lines are first sorted and joined by many tasks over ranges of
    (video, time), so that the task of that video only hashes bytes in order. The digest
    is the same either way.
    """
    order = ["timestamp_sec", "frame_id", "path"]
    rows = frames.select(
        "video_id", F.col("timestamp_sec").cast("double").alias("timestamp_sec"), "frame_id",
        F.col("path").cast("string").alias("path"),
    )
    if large is None:
        large = has_large_group(rows, ["video_id"], max_rows)
    if not large:
        return fold(rows, ["video_id"], order, _Digest, "digest string")
    placed = rows.repartitionByRange("video_id", *order).sortWithinPartitions("video_id", *order)
    pieces = fold_partitions(placed, ["video_id"], _Joined, "piece long, lines binary")
    return fold(pieces, ["video_id"], ["piece"], _JoinedDigest, "digest string")


def validate_manifests(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Compare stored and current inputs per (video_id, mode).

    ``hit`` when the keys agree, ``stale`` when they do not, ``new`` without a
    stored manifest and ``orphan`` without a current input. Digests count only
    where both sides have one.
    """
    keys = ["video_id", "mode"]
    parts = ["input_sha", "input_size", "subtitle_sha", "subtitle_size", "config_hash", "frames_digest"]
    old = stored.select(*keys, *[F.col(p).alias(f"old_{p}") for p in parts], F.lit(True).alias("has_old"))
    new = current.select(*keys, *[F.col(p).alias(f"new_{p}") for p in parts], F.lit(True).alias("has_new"))

    both = (F.coalesce("old_frames_digest", F.lit("")) != "") & (
        F.coalesce("new_frames_digest", F.lit("")) != ""
    )
    # Both keys use the current digest: it only says that both sides know one.
    digest = F.when(both, F.col("new_frames_digest"))

    def key(side: str) -> Column:
        return cache_key(
            F.col(f"{side}_input_sha"), F.col(f"{side}_input_size"), F.col(f"{side}_subtitle_sha"),
            F.col(f"{side}_subtitle_size"), F.col(f"{side}_config_hash"), digest,
        )

    return old.join(new, keys, "full_outer").select(
        *keys,
        key("old").alias("stored_key"),
        key("new").alias("current_key"),
        F.when(F.col("has_old").isNull(), "new")
        .when(F.col("has_new").isNull(), "orphan")
        .when(key("old") == key("new"), "hit")
        .otherwise("stale")
        .alias("state"),
    )


def pending_pieces(pieces: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Audio pieces still to be recognised: not in the checkpoint, or not done."""
    done = checkpoint.where("status = 'done'").select("video_id", "index")
    return pieces.join(done, ["video_id", "index"], "left_anti")


def restored_results(pieces: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Pieces whose stored result can be used again."""
    done = checkpoint.where(
        "status = 'done' AND coalesce(task_id, '') <> '' AND coalesce(result, '') <> ''"
    ).select("video_id", "index", "task_id", "result")
    return pieces.join(done, ["video_id", "index"])


def pieces_to_poll(pieces: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Pieces that were submitted and marked done, but whose result was not stored."""
    done = checkpoint.where(
        "status = 'done' AND coalesce(task_id, '') <> '' AND coalesce(result, '') = ''"
    ).select("video_id", "index", "task_id")
    return pieces.join(done, ["video_id", "index"])


def missing_pieces(pieces: DataFrame, results: DataFrame) -> DataFrame:
    """Per video with lost pieces: total, succeeded and missing counts."""
    got = results.select("video_id", "index", F.lit(1).alias("ok")).distinct()
    return (
        pieces.join(got, ["video_id", "index"], "left")
        .groupBy("video_id")
        .agg(F.count(F.lit(1)).alias("total_chunks"), F.count("ok").alias("succeeded_chunks"))
        .withColumn("missing_chunks", F.col("total_chunks") - F.col("succeeded_chunks"))
        .where("missing_chunks > 0")
    )
