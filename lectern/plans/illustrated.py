"""From prepared lectures to illustrated documents, with user-supplied models.

Text model, anchor binding, vision model, retakes, assembly. What fails is
returned as rows of its own chunk and never stops other videos.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.model_output import global_anchor_id, global_anchor_text
from lectern.operators import alignment, anchors, documents, inference, selection
from lectern.operators.alignment import CHUNK
from lectern.operators.anchors import BATCH
from lectern.plans.lecture import Prepared, assemble
from lectern.session import cut_lineage

Grabber = Callable[[DataFrame], DataFrame]


@dataclass
class Models:
    """Model functions (see ``inference.infer``) and their budgets.

    ``grab`` takes capture requests with a ``target`` path and returns the rows
    it could serve; without it such anchors stay on the capture list.
    """

    text: inference.Batches
    vision: inference.Batches
    text_template: str
    vision_intro: str
    grab: Grabber | None = None
    max_calls: int = 3
    vision_max_calls: int = 3
    vision_batch: int = 8
    max_retakes: int = 1
    tolerance: float = 2.0
    parallelism: int | None = None


@dataclass
class Illustrated:
    subtitles: DataFrame
    blog: DataFrame
    evaluations: DataFrame
    captures: DataFrame
    failed_chunks: DataFrame
    failed_anchors: DataFrame
    log: DataFrame


def text_requests(ready: Prepared, template: str) -> DataFrame:
    """(video_id, chunk_index, prompt); a request is one text by nature."""
    parts = documents.annotated_chunks(ready.segments, ready.frames, large=ready.large)
    whole = parts.groupBy(*CHUNK).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), "\n"
        ).alias("text")
    )
    return whole.select(*CHUNK, inference.text_prompt(template, F.col("text")).alias("prompt"))


def requested_anchors(answers: DataFrame, ready: Prepared) -> DataFrame:
    """Frame requests with global ids: as given where the answer is right, else repaired."""
    strict = cut_lineage(anchors.strict_answers(answers, ready.chunks, ready.frames))
    right = strict.where("valid").select(*CHUNK, F.posexplode("frame_requests").alias("pos", "r")).select(
        *CHUNK, "pos", "r.*"
    )
    wrong = answers.join(strict.where("NOT valid").select(*CHUNK), CHUNK, "left_semi")
    repaired = anchors.repaired_requests(
        wrong, ready.segments, ready.chunks, ready.frames, large=ready.large
    )
    name = global_anchor_id(F.col("anchor_id"), F.col("chunk_index").cast("string"))
    return right.unionByName(repaired).withColumn("anchor_id", name)


def vision_requests(batch_items: DataFrame, intro: str) -> DataFrame:
    """(video_id, batch, prompt): text and image segments of a batch as JSON."""
    none = F.lit(None).cast("string")

    def part(kind: str, text: Column = none, path: Column = none) -> Column:
        return F.struct(F.lit(kind).alias("type"), text.alias("text"), path.alias("path"))

    segment = F.struct(
        "pos",
        inference.vision_context(
            F.col("anchor_id"), F.col("timestamp"), F.col("subtitle_text"), F.col("frame_path")
        ).alias("text"),
        F.col("frame_path").alias("path"),
    )
    shown = F.flatten(
        F.transform(
            F.array_sort(F.collect_list(segment)),
            lambda s: F.array(part("text", text=s["text"]), part("image", path=s["path"])),
        )
    )
    return batch_items.groupBy(*BATCH).agg(
        F.to_json(F.concat(F.array(part("text", text=F.lit(intro))), shown)).alias("prompt")
    )


def judge(items: DataFrame, models: Models) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(evaluations, items without a valid decision, attempt log).

    A round asks again only for what is missing: with the items themselves after
    a partial answer, with the answer to repair after an unusable one.
    """
    prompts = vision_requests(items, models.vision_intro)
    found, logs = [], []
    for attempt in range(models.vision_max_calls):
        replies = cut_lineage(inference.infer(prompts, models.vision, BATCH, models.parallelism))
        evaluations, missing, verdicts = anchors.evaluate_batches(replies.where("response IS NOT NULL"), items)
        found.append(cut_lineage(evaluations))
        items = cut_lineage(missing)
        verdicts = verdicts.select(*BATCH, "verdict")
        logs.append(
            replies.join(verdicts, BATCH).where("response IS NOT NULL").select(
                *BATCH,
                F.lit(attempt).alias("attempt"),
                F.when(F.col("verdict") == "rejected", "schema_mismatch").alias("parse_error"),
                "response",
            )
        )
        if attempt + 1 == models.vision_max_calls or items.isEmpty():
            break
        spoiled = logs[-1].where("parse_error IS NOT NULL").select(
            *BATCH, inference.vision_repair_prompt(F.col("response")).alias("repair")
        )
        prompts = cut_lineage(
            vision_requests(items, models.vision_intro)
            .join(spoiled, BATCH, "left")
            .select(*BATCH, F.coalesce("repair", "prompt").alias("prompt"))
        )
    return _together(found), items, _together(logs)


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _batched(items: DataFrame, size: int, large: bool) -> DataFrame:
    numbered = selection.batches(items, CHUNK, ["pos"], size, large=large)
    return numbered.withColumn("batch", F.concat_ws("-", "chunk_index", "batch"))


def illustrate(ready: Prepared, titles: DataFrame, models: Models) -> Illustrated:
    """Documents of all prepared videos."""
    accepted, log, failed_chunks = inference.infer_with_retries(
        text_requests(ready, models.text_template),
        models.text,
        CHUNK,
        lambda rows: anchors.read_answers(rows).where("blog_markdown IS NOT NULL"),
        max_calls=models.max_calls,
        parallelism=models.parallelism,
    )
    answers = anchors.read_answers(accepted)
    requests = cut_lineage(requested_anchors(answers, ready))
    bound, captures, _ = alignment.anchor_frames(
        requests, ready.frames, ready.segments, models.tolerance, large=ready.large
    )
    asked = [*CHUNK, "pos", "anchor_id", "srt_id", "timestamp", "frame_path", "subtitle_text"]
    items = bound.withColumn("timestamp", F.col("frame_time")).select(*asked)
    open_captures = captures.withColumn("round", F.lit(0))
    if models.grab is not None:
        got = cut_lineage(models.grab(captures))
        taken = got.select(*CHUNK, "anchor_id", F.col("target").alias("frame_path"))
        grabbed = alignment.subtitle_of(requests.join(taken, [*CHUNK, "anchor_id"]), ready.segments)
        items = items.unionByName(grabbed.select(*asked))
        open_captures = open_captures.join(got, [*CHUNK, "anchor_id"], "left_anti")
    place = cut_lineage(items)

    rounds, failed, logs = [], [], []
    current = place
    retakes = models.max_retakes if models.grab is not None else 0
    for number in range(retakes + 1):
        batch_items = cut_lineage(_batched(current, models.vision_batch, ready.large))
        evaluations, unjudged, vision_log = judge(batch_items, models)
        rounds.append(evaluations.drop("batch").withColumn("round", F.lit(number)))
        failed.append(unjudged.select(*CHUNK, "anchor_id"))
        logs.append(vision_log)
        if number == retakes:
            break
        _, again = anchors.resolve_retakes(rounds[-1].withColumn("round", F.lit(0)), 1)
        spot = current.select(*CHUNK, "pos", "anchor_id", "subtitle_text")
        wanted = cut_lineage(again.join(spot, ["video_id", "anchor_id"]).withColumn("round", F.lit(number + 1)))
        if wanted.isEmpty():
            break
        got = cut_lineage(models.grab(wanted))
        never = wanted.join(got, ["video_id", "anchor_id"], "left_anti")
        open_captures = open_captures.unionByName(never.select(*open_captures.columns))
        current = got.withColumn("frame_path", F.col("target")).select(*asked)
    final, _ = anchors.resolve_retakes(_together(rounds), retakes)
    # Evaluations keep the order of their chunks and, within one, of the anchors.
    judged = (
        final.join(place.select(*CHUNK, "pos", "anchor_id"), ["video_id", "anchor_id"])
        .withColumn("seq", F.col("chunk_index").cast("long") * 2**32 + F.col("pos"))
        .drop("pos", "round", "forced")
    )
    judged = cut_lineage(judged)
    blogs = answers.select(
        *CHUNK,
        global_anchor_text(F.col("blog_markdown"), F.col("chunk_index").cast("string")).alias("blog_markdown"),
    )
    subtitles, blog = assemble(ready, blogs, judged, titles)
    text_log = log.select(
        F.col("video_id"), F.col("chunk_index").cast("string").alias("batch"), "attempt", "parse_error", "response"
    ).withColumn("stage", F.lit("text"))
    return Illustrated(
        subtitles=subtitles,
        blog=blog,
        evaluations=judged,
        captures=open_captures,
        failed_chunks=failed_chunks,
        failed_anchors=_together(failed),
        log=text_log.unionByName(_together(logs).withColumn("stage", F.lit("vision"))),
    )
