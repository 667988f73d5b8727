"""Cutting a video's timeline into chunks, and rows that describe a timeline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import lines, strip
from lectern.operators.ordering import (
    MAX_GROUP_ROWS, next_value, ordered, ordinal, running_sum,
)
from lectern.session import cut_lineage

BROADCAST_KEYS = 1_000_000


def timed(segments: DataFrame) -> DataFrame:
    """Segments that can be placed on the timeline."""
    return segments.where(F.col("start").isNotNull())


def untimed_counts(segments: DataFrame) -> DataFrame:
    """Per video with rows that cannot be placed: how many, of how many."""
    return (
        segments.groupBy("video_id")
        .agg(
            F.count_if(F.col("start").isNull()).alias("skipped_count"),
            F.count(F.lit(1)).alias("total_count"),
        )
        .where("skipped_count > 0")
    )


def _fold(starts: Column, seconds: float) -> Column:
    """Greedy chunk starts over the sorted starts of one video."""
    return F.aggregate(
        starts,
        F.array().cast("array<double>"),
        lambda kept, x: F.when(
            (F.size(kept) == 0) | (x - F.element_at(kept, -1) >= seconds), F.array_append(kept, x)
        ).otherwise(kept),
    )


def _opening_time(start: Column, seconds: float) -> Column:
    """The least double ``x`` with ``x - start >= seconds``.

    ``start + seconds`` can be off by one rounding step, so its neighbours are
    tried as well.
    """
    guess = start + F.lit(seconds)
    # Between half and one unit in the last place: one rounding step either way.
    step = F.abs(guess) * (2.0**-53 * (1 + 2.0**-10))
    tries = [guess - step - step, guess - step, guess, guess + step, guess + step + step]
    return F.coalesce(*[F.when(x - start >= seconds, x) for x in tries])


def _chain(starts: DataFrame, seconds: float, max_rows: int) -> DataFrame:
    """Greedy chunk starts of large videos, without gathering a video in one task.

    Each start points to the first start at least ``seconds`` later. The chain
    from a video's first start is found by pointer doubling: round k knows the
    first 2^k chunk starts and jumps of length 2^k, so the number of rounds is
    the logarithm of the number of chunks. All joins are on (video, start).
    """
    opening = starts.select(
        "video_id",
        _opening_time(F.col("start"), seconds).alias("t"),
        F.lit(0).alias("kind"),
        F.col("start"),
    )
    points = starts.select("video_id", F.col("start").alias("t"), F.lit(1).alias("kind"), "start")
    jumps = ordered(
        opening.unionByName(points),
        ["video_id"],
        ["t", "kind", "start"],
        {"target": next_value(F.when(F.col("kind") == 1, F.col("start")))},
        max_rows=max_rows,
    )
    jumps = cut_lineage(jumps.where("kind = 0").select("video_id", "start", "target").dropna())
    known = cut_lineage(starts.groupBy("video_id").agg(F.min("start").alias("start")))
    while True:
        found = cut_lineage(
            known.join(jumps, ["video_id", "start"]).select("video_id", F.col("target").alias("start"))
        )
        if found.isEmpty():
            break
        known = cut_lineage(known.unionByName(found))
        onward = jumps.select("video_id", F.col("start").alias("target"), F.col("target").alias("far"))
        jumps = cut_lineage(
            jumps.join(onward, ["video_id", "target"]).select("video_id", "start", F.col("far").alias("target"))
        )
    return ordered(
        known, ["video_id"], ["start"], {"n": ordinal()}, max_rows=max_rows
    ).select("video_id", (F.col("n") - 1).cast("int").alias("chunk_index"), F.col("start").alias("chunk_start"))


def _seconds(segment_minutes: float) -> float:
    seconds = float(segment_minutes) * 60.0
    if seconds <= 0:
        raise ValueError(f"segment_minutes must be > 0, got {segment_minutes}")
    return seconds


def chunk_starts(
    segments: DataFrame, segment_minutes: float = 10.0, *, max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """(video_id, chunk_index, chunk_start) of the greedy cut.

    A chunk opens at the first segment that starts at least ``segment_minutes``
    after the current chunk's own first segment, so boundaries depend on the
    data and not on a fixed grid.
    """
    seconds = _seconds(segment_minutes)
    starts = timed(segments).select("video_id", "start")
    large = starts.groupBy("video_id").count().where(F.col("count") > max_rows).select("video_id")
    n_large = large.count()
    small = starts
    if n_large:
        large = cut_lineage(large)
        side = F.broadcast(large) if n_large <= BROADCAST_KEYS else large
        small = starts.join(side, "video_id", "left_anti")
    out = (
        small.groupBy("video_id")
        .agg(F.array_sort(F.collect_set("start")).alias("starts"))
        .select("video_id", F.posexplode(_fold(F.col("starts"), seconds)).alias("chunk_index", "chunk_start"))
    )
    if n_large:
        big = starts.join(side, "video_id", "left_semi").distinct()
        out = out.unionByName(_chain(cut_lineage(big), seconds, max_rows))
    return out


def assign_chunks(
    segments: DataFrame, starts: DataFrame, segment_minutes: float = 10.0
) -> DataFrame:
    """Timed segments with the chunk they belong to.

    A chunk holds the starts in ``[chunk_start, chunk_start + N)``. Both sides
    are keyed by (video, N-minute cell), a chunk being listed in the cells it can
    reach, so the join is an equi-join that spreads a long video over many tasks.
    """
    seconds = float(segment_minutes) * 60.0
    cell = F.floor(F.col("chunk_start") / seconds)
    reach = starts.withColumn("__cell", F.explode(F.array(cell, cell + 1, cell + 2)))
    placed = timed(segments).withColumn("__cell", F.floor(F.col("start") / seconds))
    return (
        placed.join(reach, ["video_id", "__cell"])
        .where((F.col("start") >= F.col("chunk_start")) & (F.col("start") - F.col("chunk_start") < seconds))
        .drop("__cell", "chunk_start")
    )


def numbered_members(segments: DataFrame, segment_minutes: float = 10.0) -> DataFrame:
    """Timed segments with ``chunk_index``, ``srt_id`` and what the chunk table says of their chunk.

    For videos that fit one task each. The chunk starts of a video are one array, met in
    a join on the video; all windows then run where the rows of the video are. The row with
    ``srt_id`` 1 of a chunk stands for it, see ``first_rows``.
    """
    rows = timed(segments)
    arrays = rows.groupBy("video_id").agg(
        _fold(F.array_sort(F.collect_set("start")), _seconds(segment_minutes)).alias("__starts")
    )
    before = F.filter("__starts", lambda x: x <= F.col("start"))
    placed = rows.join(arrays, "video_id").select(*segments.columns, (F.size(before) - 1).alias("chunk_index"))
    video = Window.partitionBy("video_id").orderBy("start", "seq")
    chunk = Window.partitionBy("video_id", "chunk_index")
    inside = chunk.orderBy("start", "seq")
    placed = placed.select(
        "*",
        F.row_number().over(inside).cast("long").alias("srt_id"),
        F.row_number().over(video).cast("long").alias("__place"),
        F.count(F.lit(1)).over(chunk).alias("n_segments"),
        F.min("start").over(chunk).alias("start_sec"),
        F.last(F.coalesce("end", "start")).over(
            inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ).alias("end_sec"),
    )
    closing = F.when(F.col("srt_id") == F.col("n_segments"), F.col("end_sec"))
    past = F.max(closing).over(video.rowsBetween(Window.unboundedPreceding, -1))
    return placed.select(
        *segments.columns, "chunk_index", "srt_id", "start_sec", "end_sec", "n_segments",
        (F.col("__place") - F.col("srt_id")).alias("segment_offset"),
        F.when(F.col("srt_id") == 1, F.greatest("start_sec", past)).alias("from_sec"),
    )


def first_rows(numbered: DataFrame) -> DataFrame:
    """The chunk table of ``numbered_members``, without a shuffle."""
    columns = ["video_id", "chunk_index", "start_sec", "end_sec", "n_segments", "segment_offset", "from_sec"]
    return numbered.where("srt_id = 1").select(*columns)


def chunk_table(members: DataFrame) -> DataFrame:
    """Per chunk: first start, the last segment's end (not the largest), row count."""
    last = F.struct("start", "seq")
    return members.groupBy("video_id", "chunk_index").agg(
        F.min("start").alias("start_sec"),
        F.max_by(F.coalesce("end", "start"), last).alias("end_sec"),
        F.count(F.lit(1)).alias("n_segments"),
    )


def number_segments(members: DataFrame, **options) -> DataFrame:
    """1-based segment number within the chunk, in time order."""
    return ordered(
        members, ["video_id", "chunk_index"], ["start", "seq"], {"srt_id": ordinal()}, **options
    )


def chunk_offsets(chunks: DataFrame, **options) -> DataFrame:
    """Number of segments in earlier chunks of the video."""
    return ordered(
        chunks,
        ["video_id"],
        ["chunk_index"],
        {"__before": running_sum(F.col("n_segments"), inclusive=False)},
        **options,
    ).select(*chunks.columns, F.coalesce("__before", F.lit(0)).cast("long").alias("segment_offset"))


def split_plan(media: DataFrame, chunk_seconds: float) -> DataFrame:
    """Consecutive audio pieces that cover each medium's duration."""
    n = F.ceil(F.col("duration_sec") / chunk_seconds)
    return (
        media.where("duration_sec > 0")
        .select("video_id", "duration_sec", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("index"))
        .withColumn("start_sec", F.col("index") * F.lit(float(chunk_seconds)))
        .select(
            "video_id",
            "index",
            "start_sec",
            F.least(F.lit(float(chunk_seconds)), F.col("duration_sec") - F.col("start_sec")).alias("piece_sec"),
        )
    )


def interval_grid(media: DataFrame, interval: float = 30.0) -> DataFrame:
    """Fallback frame times: 0, interval, 2*interval, ... below the duration."""
    n = F.ceil(F.col("duration_sec") / interval)
    steps = F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("i")
    return media.where("duration_sec > 0").select("video_id", steps).select(
        "video_id", (F.col("i") * F.lit(float(interval))).alias("timestamp_sec")
    )


def running_starts(steps: str, block: int = 256) -> str:
    """SQL for the sums before each element of an array of doubles, added from left to right.

    Folded in blocks that hand on their sum: the copies that a fold makes of its result
    stay short, and the additions are those of one plain loop.
    """
    inner = (
        f"aggregate(slice({steps}, b * {block} + 1, {block}),"
        " named_struct('at', acc.at, 'out', CAST(array() AS array<double>)),"
        " (s, x) -> named_struct('at', s.at + x, 'out', concat(s.out, array(s.at))))"
    )
    return (
        f"flatten(aggregate(transform(sequence(0, greatest(size({steps}) - 1, 0) div {block}), b -> b),"
        " named_struct('at', 0D, 'out', CAST(array() AS array<array<double>>)),"
        f" (acc, b) -> element_at(transform(array({inner}), d -> named_struct('at', d.at, 'out', concat(acc.out, array(d.out)))), 1),"
        " acc -> acc.out))"
    )


def synthesize_segments(texts: DataFrame) -> DataFrame:
    """Timed segments for untimed text, in proportion to line length.

    ``texts`` is (video_id, text, duration_sec), one row per video; everything is computed inside the row.
    """
    kept = F.filter(F.transform(lines(F.col("text")), strip), lambda x: x != "")
    rows = texts.select("video_id", kept.alias("lines"), F.col("duration_sec").cast("double").alias("given"))
    rows = rows.withColumn("weights", F.transform("lines", lambda x: F.greatest(F.lit(1), F.length(x))))
    rows = rows.withColumns(
        {
            "total": F.aggregate("weights", F.lit(0).cast("long"), lambda acc, x: acc + x),
            "duration": F.when(F.col("given") > 0, F.col("given")).otherwise(
                F.greatest(F.lit(4.5), F.size("lines") * 4.5)
            ),
        }
    )
    rows = rows.withColumn("steps", F.transform("weights", lambda w: F.col("duration") * w / F.col("total")))
    rows = rows.withColumn("starts", F.expr(running_starts("steps")))
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array("duration"))
    rows = rows.where(F.size("lines") > 0).select(
        "video_id", F.posexplode(F.arrays_zip(F.col("lines").alias("text"), F.col("starts").alias("start"), ends.alias("end"))).alias("pos", "s")
    )
    return rows.select(
        "video_id", F.col("pos").cast("long").alias("seq"), F.col("s.text").alias("text"), F.col("s.start").alias("start"),
        F.greatest(F.col("s.start") + 0.1, F.col("s.end")).alias("end"),
    )


def even_positions(position: Column, count: Column, k: int) -> Column:
    """True for the 0-based positions of an even pick of ``k`` out of ``count``.

    Position ``i`` is picked when some ``j < k`` has ``rint(j * step) = i``; only
    the ``j`` next to ``i / step`` can.
    """
    if k <= 0:
        raise ValueError("at least one position must be picked")
    if k == 1:
        return position == 0
    step = (count - 1) / F.lit(float(k - 1))
    near = F.floor(position / step)
    picks = [
        (near + d >= 0) & (near + d <= k - 1) & (F.rint((near + d) * step) == position)
        for d in (-1, 0, 1)
    ]
    return (count <= k) | reduce(lambda a, b: a | b, picks)
