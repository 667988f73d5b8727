"""Greedy near-duplicate removal over 64-bit perceptual hashes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.alignment import earliest_frames
from lectern.operators.ordering import ordered, ordinal
from lectern.session import cut_lineage

FOLD_ROWS = 20_000
ROUND_ROWS = 1_000
BLOCK_ROWS = 4_000
BROADCAST_ROWS = 1_000_000
#: Largest distance at which keys of two pieces of a hash still tell hashes apart.
TIGHT = 6


def largest_duplicate_distance(threshold: float) -> int:
    """Largest Hamming distance d with ``1 - d/64 > threshold``, -1 if none."""
    fits = [d for d in range(65) if 1.0 - d / 64.0 > threshold]
    return max(fits) if fits else -1


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def unhashed(frames: DataFrame) -> DataFrame:
    """One skipped-frame event per frame without a hash."""
    return frames.where("phash IS NULL").select(
        "video_id",
        "frame_id",
        F.lit("skipped_frames").alias("bucket"),
        F.lit("keyframe_dedup").alias("stage"),
        "path",
        "timestamp_sec",
    )


def _fold(rows: DataFrame, d_max: int, limit: int, keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """Greedy selection over the rows of each video, or block, as one array."""
    element = F.struct("timestamp_sec", "frame_id", "phash")
    empty = F.array().cast("array<struct<timestamp_sec:double,frame_id:bigint,phash:bigint>>")
    return (
        rows.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(element)).alias("rows"))
        .select(
            *keys,
            F.inline(
                F.aggregate(
                    "rows",
                    empty,
                    lambda kept, x: F.when(
                        (F.size(kept) >= limit)
                        | F.exists(kept, lambda k: _distance(k["phash"], x["phash"]) <= d_max),
                        kept,
                    ).otherwise(F.array_append(kept, x)),
                )
            ),
        )
    )


def _in_rounds(rows: DataFrame, d_max: int, limit: int, round_rows: int) -> DataFrame:
    """Greedy selection for videos too large to fold.

    A round folds the first ``round_rows`` undecided rows of each video, then
    drops all undecided rows close to a newly kept one. What is left is unlike
    every kept row, so the first of it is kept in the next round and the rounds
    end. Row pairs are never built: each undecided row is compared with the
    round's kept rows of its video, at most ``round_rows`` of them.
    """
    undecided, total = cut_lineage(rows), None
    order = Window.partitionBy("video_id").orderBy("timestamp_sec", "frame_id")
    while not undecided.isEmpty():
        head = (
            undecided.withColumn("__rank", F.row_number().over(order))
            .where(F.col("__rank") <= round_rows)
            .drop("__rank")
        )
        kept = cut_lineage(_fold(head, d_max, limit))
        total = kept if total is None else cut_lineage(total.unionByName(kept))
        full = (
            total.groupBy("video_id").count().where(F.col("count") >= limit).select("video_id")
        )
        # Arrays of at most round_rows hashes, one per large video.
        hashes = kept.groupBy("video_id").agg(F.collect_list("phash").alias("__kept"))
        n_large = hashes.count()
        side = F.broadcast(hashes) if n_large * round_rows <= BROADCAST_ROWS else hashes
        undecided = cut_lineage(
            undecided.join(side, "video_id")
            .join(full, "video_id", "left_anti")
            .where(~F.exists("__kept", lambda k: _distance(k, F.col("phash")) <= d_max))
            .drop("__kept")
        )
    if total is None:
        return rows
    first = F.row_number().over(order)
    return total.withColumn("__rank", first).where(F.col("__rank") <= limit).drop("__rank")


def _keys(phash: Column, d_max: int) -> Column:
    """Keys of which two hashes at most ``d_max`` bits apart share at least one.

    The 64 bits are cut into ``d_max + 2`` pieces; so many differing bits leave two
    pieces untouched, and every pair of pieces is a key.
    """
    n = d_max + 2
    cuts = [round(64 * i / n) for i in range(n + 1)]
    masks = [sum(1 << bit for bit in range(a, b)) for a, b in zip(cuts, cuts[1:])]
    pairs = [masks[i] | masks[j] for i in range(n) for j in range(i)]
    signed = [m - 2**64 if m >= 2**63 else m for m in pairs]
    return F.array(
        *[F.struct(F.lit(k).alias("key"), phash.bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(signed)]
    )


def _in_blocks(rows: DataFrame, d_max: int, limit: int, block_rows: int) -> DataFrame:
    """Greedy selection for large videos at tight thresholds, all blocks of time at once.

    Every block is folded by itself; then again without the rows close to what earlier
    blocks kept in the last round, until nothing changes. The first block is right at
    once, and a block is right one round after those before it; in practice it takes a
    few rounds, as rows rarely hang together over many blocks. Close rows meet through
    the keys of their hashes, and only kept rows are looked up, so a pile of near copies
    makes no pairs.
    """
    at = ["video_id", "timestamp_sec", "frame_id"]
    placed = ordered(rows.select(*at, "phash"), ["video_id"], at[1:], {"__pos": ordinal()}, max_rows=block_rows)
    placed = cut_lineage(placed.withColumn("__block", F.floor((F.col("__pos") - 1) / block_rows)).drop("__pos"))
    keyed = placed.select("*", F.inline(_keys(F.col("phash"), d_max)))
    free, kept = placed, None
    while True:
        now = cut_lineage(_fold(free, d_max, 2**31 - 1, ("video_id", "__block")))
        if kept is not None and now.count() == kept.count() and now.join(kept, at, "left_anti").isEmpty():
            break
        kept = now
        lookup = kept.select(
            "video_id", F.col("__block").alias("__from"), F.col("phash").alias("__hash"),
            F.inline(_keys(F.col("phash"), d_max)),
        )
        close = keyed.join(lookup, ["video_id", "key", "bits"]).where(
            (F.col("__from") < F.col("__block")) & (_distance(F.col("phash"), F.col("__hash")) <= d_max)
        )
        free = placed.join(close.select(*at).distinct(), at, "left_anti")
    first = ordered(kept, ["video_id"], at[1:], {"__rank": ordinal()}, max_rows=block_rows)
    return first.where(F.col("__rank") <= limit).select(*at, "phash")


def deduplicate(
    frames: DataFrame,
    threshold: float = 0.9,
    max_frames: int = 100,
    *,
    fold_rows: int = FOLD_ROWS,
    round_rows: int = ROUND_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Frames kept by the greedy rule, in time order per video.

    A frame is dropped when it is too similar to an earlier *kept* frame; dropped
    frames suppress nothing. Selection stops after ``max_frames`` kept frames.
    Frames without a hash are skipped, and a video that keeps nothing keeps its
    first frame. Videos of more than ``fold_rows`` distinct hashes go block by block, when
    the threshold is tight and more than ``round_rows`` frames may be kept, else in rounds
    over their first undecided rows.
    """
    d_max = largest_duplicate_distance(threshold)
    limit = max(int(max_frames), 1) if math.isfinite(max_frames) else 2**31 - 1
    hashed = frames.where("phash IS NOT NULL").select("video_id", "timestamp_sec", "frame_id", "phash")
    if d_max < 0:  # nothing counts as similar
        return _with_unhashed(frames, earliest_frames(hashed, limit))
    # Copies of a hash either fall to its first frame or share its fate.
    first = F.min(F.struct("timestamp_sec", "frame_id")).alias("first")
    hashed = hashed.groupBy("video_id", "phash").agg(first).select(
        "video_id", "first.timestamp_sec", "first.frame_id", "phash"
    )
    large = hashed.groupBy("video_id").count().where(F.col("count") > fold_rows).select("video_id")
    n_large = large.count()
    if n_large:
        large = cut_lineage(large)
        side = F.broadcast(large) if n_large <= BROADCAST_ROWS else large
        long = hashed.join(side, "video_id", "left_semi")
        if d_max <= TIGHT and limit > round_rows:
            long = _in_blocks(long, d_max, limit, block_rows)
        else:
            long = _in_rounds(long, d_max, limit, round_rows)
        kept = _fold(hashed.join(side, "video_id", "left_anti"), d_max, limit).unionByName(long)
    else:
        kept = _fold(hashed, d_max, limit)
    return _with_unhashed(frames, kept)


def _with_unhashed(frames: DataFrame, kept: DataFrame) -> DataFrame:
    """The kept frames, and the first frame of every video that keeps nothing."""
    ids = kept.select("video_id", "frame_id")
    # A video keeps nothing only when none of its frames has a hash.
    first = (
        frames.groupBy("video_id")
        .agg(
            F.min_by("frame_id", F.struct("timestamp_sec", "frame_id")).alias("frame_id"),
            F.count("phash").alias("n"),
        )
        .where("n = 0")
        .select("video_id", "frame_id")
    )
    return frames.join(ids.unionByName(first), ["video_id", "frame_id"], "left_semi")
