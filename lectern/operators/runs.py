"""Fault-tolerance events of runs: reports, warnings, status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.ordering import ordered, ordinal

# Bucket names, in the order reports list them.
BUCKETS = ["failed_segments", "fallbacks", "skipped_frames", "cache_hits", "repairs"]
DEGRADING = ["failed_segments", "fallbacks", "skipped_frames"]

PAGE_EVENTS = 10_000


def merge_events(runs: DataFrame, worker_events: DataFrame) -> DataFrame:
    """Events recorded by workers joined to the run's own, all five buckets."""
    return runs.unionByName(worker_events.where(F.col("bucket").isin(BUCKETS)))


def bucket_counts(events: DataFrame) -> DataFrame:
    """One row per run with a count per bucket, zero included."""
    return events.groupBy("run_id").agg(
        *[F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS]
    )


def run_status(events: DataFrame, runs: DataFrame) -> DataFrame:
    """error > degraded > success, over all runs (id, error)."""
    degraded = events.groupBy("run_id").agg(
        F.bool_or(F.col("bucket").isin(DEGRADING)).alias("degraded")
    )
    return runs.join(degraded, "run_id", "left").select(
        "run_id",
        F.coalesce("degraded", F.lit(False)).alias("degraded"),
        F.when(F.col("error").isNotNull(), "error")
        .when(F.coalesce("degraded", F.lit(False)), "degraded")
        .otherwise("success")
        .alias("status"),
    )


def warnings(events: DataFrame, **options) -> DataFrame:
    """Degrading events in time order; equal times by bucket, then by recording order."""
    rank = F.array_position(F.array(*[F.lit(b) for b in DEGRADING]), F.col("bucket"))
    rows = events.where(F.col("bucket").isin(DEGRADING)).withColumn("__bucket", rank)
    return ordered(
        rows, ["run_id"], ["ts", "__bucket", "seq"], {"position": ordinal()}, **options
    ).select("run_id", "position", "bucket", "message", "ts")


def report_pages(
    events: DataFrame, runs: DataFrame, *, page_events: int = PAGE_EVENTS, **options
) -> DataFrame:
    """Run reports: status, counts and the events per bucket.

    A run with more than ``page_events`` events continues on further pages, each
    with the same head. A run without events has one empty page.
    """
    numbered = ordered(events, ["run_id"], ["seq"], {"__pos": ordinal()}, **options)
    event = F.struct("seq", "stage", "message", "detail", "ts")
    pages = (
        numbered.withColumn("page", F.floor((F.col("__pos") - 1) / page_events).cast("int"))
        .groupBy("run_id", "page")
        .agg(
            *[
                F.array_sort(
                    F.collect_list(F.when(F.col("bucket") == b, event)),
                    lambda x, y: F.when(x["seq"] < y["seq"], -1).when(x["seq"] > y["seq"], 1).otherwise(0),
                ).alias(f"{b}_events")
                for b in BUCKETS
            ]
        )
    )
    heads = run_status(events, runs).join(bucket_counts(events), "run_id", "left").join(
        runs.select("run_id", "error"), "run_id"
    )
    return (
        heads.join(pages, "run_id", "left")
        .na.fill(0, ["page", *BUCKETS])
        .select(
            "run_id",
            "page",
            "status",
            "error",
            F.struct(*BUCKETS).alias("summary"),
            *[F.coalesce(f"{b}_events", F.array()).alias(b) for b in BUCKETS],
        )
    )


def last_per_key(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Last value per key; ``first_seq`` keeps the order of first insertion."""
    rest = [c for c in rows.columns if c not in [*keys, seq]]
    return rows.groupBy(*keys).agg(
        *[F.max_by(c, seq).alias(c) for c in rest], F.min(seq).alias("first_seq")
    )
