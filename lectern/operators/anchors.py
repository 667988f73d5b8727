"""Checking, repairing and completing structured model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.model_output import (
    REQUEST_STRUCT, anchors, frame_decision, frame_request, items, json_objects, string_field,
)
from lectern.functions.text import let, one_decimal, strip
from lectern.operators.alignment import CHUNK, nearest_segment
from lectern.session import cut_lineage

# Texts stored in repaired rows.
COMPLETED_REASON = "程序根据 blog_markdown 中的锚点自动补全"
RECAPTURE_REASON = ("模型引用了无效候选帧，改为按 ", "s 补截")
KEPT_REASON = "retake 超限，保守保留当前帧"
UNSERVED_REASON = "retake frame was not captured"


def read_answers(responses: DataFrame) -> DataFrame:
    """Text-model answers as (keys, blog_markdown, markers, requests), parsed once.

    ``blog_markdown`` is null unless it is a non-blank string. ``requests`` is
    null unless it is a list, with a null for each malformed entry. Every check
    below reads these columns several times, so they are written once.
    """
    blog = string_field(F.col("obj"), "blog_markdown")
    return cut_lineage(
        json_objects(responses.select(*CHUNK, "response"), "response")
        .select(*CHUNK, blog.alias("blog"), items(F.col("obj"), "frame_requests").alias("listed"))
        .select(
            *CHUNK,
            F.when(strip(F.col("blog")) != "", F.col("blog")).alias("blog_markdown"),
            anchors(F.coalesce("blog", F.lit(""))).alias("markers"),
            F.transform("listed", frame_request).alias("requests"),
        )
    )


def _ids(rows: Column) -> Column:
    return F.transform(rows, lambda r: r["anchor_id"])


def _known_paths(placed: DataFrame) -> DataFrame:
    return placed.select(*CHUNK, F.col("path").alias("source_frame_path")).distinct().withColumn(
        "__known", F.lit(True)
    )


def strict_answers(answers: DataFrame, chunks: DataFrame, placed: DataFrame) -> DataFrame:
    """Per chunk: does the answer (from ``read_answers``) satisfy every rule, and its requests if so.

    Rules inside one answer are array expressions on its row; only the segment
    count and the candidate paths come from joins.
    """
    parsed = answers.join(chunks.select(*CHUNK, "n_segments"), CHUNK, "left")
    ids, marked = _ids(F.col("requests")), _ids(F.col("markers"))

    def agrees(marker: Column) -> Column:
        return F.exists(
            "requests",
            lambda r: (r["anchor_id"] == marker["anchor_id"])
            & (F.abs(r["timestamp"] - marker["timestamp"]) <= 1e-6)
            & (r["srt_id"] <= F.coalesce("n_segments", F.lit(0))),
        )

    checked = parsed.withColumn(
        "consistent",
        F.coalesce(
            F.col("blog_markdown").isNotNull()
            & ~F.exists("requests", lambda r: r.isNull())
            & (F.size(F.array_distinct(ids)) == F.size(ids))
            & (F.size(F.array_except(ids, marked)) == 0)
            & F.forall("markers", agrees),
            F.lit(False),
        ),
    )
    wanted = checked.where("consistent").select(*CHUNK, F.explode("requests").alias("r")).where(
        "r.request_type = 'reuse'"
    ).select(*CHUNK, F.col("r.source_frame_path").alias("source_frame_path"))
    unknown = (
        wanted.join(_known_paths(placed), [*CHUNK, "source_frame_path"], "left_anti")
        .select(*CHUNK)
        .distinct()
        .withColumn("__unknown", F.lit(True))
    )
    valid = F.col("consistent") & F.col("__unknown").isNull()
    return checked.join(unknown, CHUNK, "left").select(
        *CHUNK,
        valid.alias("valid"),
        "blog_markdown",
        F.when(valid, F.col("requests")).cast(f"array<{REQUEST_STRUCT}>").alias("frame_requests"),
    )


def repaired_requests(
    answers: DataFrame, numbered: DataFrame, chunks: DataFrame, placed: DataFrame, **options
) -> DataFrame:
    """One request per anchor of the text, completed where the answer falls short.

    The text decides: its first marker of an id gives the time. The request of
    that id is used where valid, a reuse of an unknown frame becomes a new
    capture, and a missing segment number becomes the nearest segment.
    """
    parsed = answers.where("blog_markdown IS NOT NULL")
    usable = F.filter("requests", lambda r: r.isNotNull())
    rows = (
        parsed.withColumn("requests", usable)
        .withColumn(
            "markers",
            let(
                _ids(F.col("markers")),
                lambda ids: F.filter("markers", lambda m, i: F.array_position(ids, m["anchor_id"]) == i + 1),
            ),
        )
        .select(*CHUNK, "requests", F.posexplode("markers").alias("pos", "m"))
        .select(
            *CHUNK,
            "pos",
            F.col("m.anchor_id").alias("anchor_id"),
            F.col("m.timestamp").alias("timestamp"),
            F.get(F.filter("requests", lambda r: r["anchor_id"] == F.col("m.anchor_id")), F.lit(0)).alias("r"),
        )
        .withColumn("source_frame_path", F.col("r.source_frame_path"))
    )
    rows = (
        nearest_segment(numbered, rows, **options)
        .join(chunks.select(*CHUNK, "n_segments"), CHUNK, "left")
        .join(_known_paths(placed), [*CHUNK, "source_frame_path"], "left")
    )
    reuse = F.coalesce(F.col("r.request_type") == "reuse", F.lit(False))
    broken = reuse & F.col("__known").isNull()
    before, after = RECAPTURE_REASON
    return rows.select(
        *CHUNK,
        "pos",
        "anchor_id",
        F.when(F.col("r.srt_id").between(1, F.coalesce("n_segments", F.lit(0))), F.col("r.srt_id"))
        .otherwise(F.col("nearest_srt_id")).cast("int").alias("srt_id"),
        "timestamp",
        F.when(reuse & ~broken, "reuse").otherwise("new_capture").alias("request_type"),
        F.when(reuse & ~broken, F.col("source_frame_path")).alias("source_frame_path"),
        F.when(broken, F.concat(F.lit(before), one_decimal(F.col("timestamp")), F.lit(after)))
        .otherwise(F.coalesce(F.nullif(F.col("r.reason"), F.lit("")), F.lit(COMPLETED_REASON)))
        .alias("reason"),
    )


def first_by_position(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The first row per key, by position."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), position).alias("__row")).select(
        *keys, *[F.col(f"__row.{c}").alias(c) for c in rest]
    )


BATCH = ["video_id", "batch"]


def match_decisions(decisions: DataFrame, batch_items: DataFrame) -> DataFrame:
    """Decisions with the item they speak about.

    An id matches exactly, else as the only item that ends in ``_<id>``. Endings
    are listed per item, so the second match is an equi-join too.
    """
    names = batch_items.select(*BATCH, F.col("anchor_id").alias("item_id"))
    parts = F.split("item_id", "_")
    endings = names.select(
        *BATCH,
        "item_id",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size(parts) - 1),
                lambda i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "_"),
            )
        ).alias("anchor_id"),
    ).where(F.instr("item_id", "_") > 0)
    only = (
        endings.groupBy(*BATCH, "anchor_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("by_ending"))
        .where("n = 1 AND anchor_id <> ''")
        .drop("n")
    )
    exact = names.select(*BATCH, F.col("item_id").alias("anchor_id"), F.col("item_id").alias("by_name"))
    return (
        decisions.join(exact, [*BATCH, "anchor_id"], "left")
        .join(only, [*BATCH, "anchor_id"], "left")
        .select(*decisions.columns, F.coalesce("by_name", "by_ending").alias("item_id"))
    )


def read_decisions(responses: DataFrame) -> DataFrame:
    """Vision answers (video_id, batch, response) as one row per decision."""
    parsed = json_objects(responses.select(*BATCH, "response"), "response")
    return (
        parsed.select(*BATCH, F.posexplode(items(F.col("obj"), "decisions")).alias("pos", "decision"))
        .withColumn("anchor_id", string_field(F.col("decision"), "anchor_id"))
    )


def evaluate_batches(responses: DataFrame, batch_items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(evaluations, missing items, verdict per batch).

    A batch is ``strict`` when every decision is valid and names its own item,
    ``repaired`` when each item still got a valid decision, ``partial`` when some
    did, ``rejected`` otherwise. Recovered decisions are always kept.
    """
    matched = match_decisions(read_decisions(responses), batch_items)
    asked = batch_items.select(*BATCH, F.col("anchor_id").alias("item_id"), "srt_id", "frame_path", "timestamp")
    verdict = F.when(F.col("item_id").isNotNull(), frame_decision(F.col("decision"), F.col("frame_path")))
    judged = cut_lineage(
        matched.join(asked, [*BATCH, "item_id"], "left").select(
            *BATCH, "pos", "item_id", "srt_id", "timestamp", verdict.alias("e")
        )
    )
    best = judged.where("e IS NOT NULL").groupBy(*BATCH, "item_id").agg(
        F.min_by(F.struct("srt_id", "timestamp", "e"), "pos").alias("row")
    )
    evaluations = best.select(
        *BATCH, F.col("item_id").alias("anchor_id"), "row.srt_id", "row.timestamp", "row.e.*"
    )
    missing = batch_items.join(evaluations.select(*BATCH, "anchor_id"), [*BATCH, "anchor_id"], "left_anti")
    counts = judged.groupBy(*BATCH).agg(
        F.count(F.lit(1)).alias("n_decisions"),
        F.count_if(F.col("e").isNotNull()).alias("n_valid"),
        F.count_distinct("item_id").alias("n_named"),
    )
    got = evaluations.groupBy(*BATCH).agg(F.count(F.lit(1)).alias("n_recovered"))
    verdicts = (
        batch_items.groupBy(*BATCH)
        .agg(F.count(F.lit(1)).alias("n_items"))
        .join(counts, BATCH, "left")
        .join(got, BATCH, "left")
        .na.fill(0, ["n_decisions", "n_valid", "n_named", "n_recovered"])
        .withColumn(
            "verdict",
            F.when(
                (F.col("n_decisions") == F.col("n_items"))
                & (F.col("n_valid") == F.col("n_items"))
                & (F.col("n_named") == F.col("n_items")),
                "strict",
            )
            .when(F.col("n_recovered") == F.col("n_items"), "repaired")
            .when(F.col("n_recovered") > 0, "partial")
            .otherwise("rejected"),
        )
    )
    return evaluations, missing, verdicts


def resolve_retakes(rounds: DataFrame, max_retakes: int = 1) -> tuple[DataFrame, DataFrame]:
    """(final evaluation per anchor, frames to grab for the next rounds).

    The ``outcome`` of an anchor is ``kept`` at its first round without a retake,
    ``forced`` when it still asks for one in round ``max_retakes`` (the frame is then kept
    as it is), and ``unserved`` when its last round asks for a retake that never came:
    that evaluation stands, with a reason. A frame to grab is ``served`` when a later
    round of its anchor is there.
    """
    inside = rounds.where(F.col("round") <= max_retakes)
    keys = ["video_id", "anchor_id"]
    rest = F.struct(*[c for c in rounds.columns if c not in keys])
    ends = ~F.col("retake") | (F.col("round") == max_retakes)
    last = (
        inside.groupBy(*keys)
        .agg(
            F.min_by(rest, F.when(ends, F.col("round"))).alias("end"),
            F.max_by(rest, F.col("round")).alias("last"),
        )
        .withColumn("outcome", F.when(F.col("end").isNull(), "unserved").when(F.col("end.retake"), "forced").otherwise("kept"))
        .withColumn("row", F.coalesce("end", "last"))
        .select(*keys, "row.*", "outcome")
    )
    unsaid = F.coalesce("reason", F.lit("")) == ""
    final = last.withColumns(
        {
            "forced": F.col("outcome") == "forced",
            "keep_image": F.col("keep_image") | (F.col("outcome") == "forced"),
            "reason": F.when((F.col("outcome") == "forced") & unsaid, KEPT_REASON)
            .when((F.col("outcome") == "unserved") & unsaid, UNSERVED_REASON)
            .otherwise(F.col("reason")),
            "retake_timestamp": F.when(F.col("outcome") != "forced", F.col("retake_timestamp")),
            "retake": F.lit(False),
        }
    )
    at = F.coalesce(F.nullif("retake_timestamp", F.lit(0.0)), F.col("timestamp"))
    latest = F.max("round").over(Window.partitionBy(*keys))
    captures = (
        inside.withColumn("__latest", latest)
        .where(F.col("retake") & (F.col("round") < max_retakes))
        .select(
            *keys,
            (F.col("round") + 1).alias("round"),
            "srt_id",
            at.alias("timestamp"),
            F.format_string("retakes/%s_retake_%03d_%.3f.jpg", F.col("anchor_id"), F.col("srt_id"), at).alias("target"),
            (F.col("__latest") > F.col("round")).alias("served"),
        )
    )
    return final, captures
