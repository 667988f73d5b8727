"""Subtitle files and provider payloads to segment rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import DIGITS, SRT_TIME, VTT_TIME, let, lines, parse_time, strip

# Names of unlabelled tracks and the parts of a minimum length.
TRACK_ID = "subtitle-"
TRACK_LABEL = "字幕 "
SPEAKER_MARK = ">>"
LEAST_SECONDS = 0.2
OPEN_CUE_SECONDS = 3.0

TIMED_SUFFIX = r"(?i)\.(srt|vtt)\z"

_TIMING = rf"(?U)\A(?:({SRT_TIME})\s*-->\s*({SRT_TIME})|({VTT_TIME})\s*-->\s*({VTT_TIME}))"


def read_subtitle_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of every file under ``path``, one row per file."""
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(
        F.input_file_name().alias("path"), F.col("value").alias("text")
    )


def cues(text: Column) -> Column:
    """Timed cues of one subtitle text, sorted by (start, end)."""
    # splitlines also breaks at lone carriage returns; blocks break at blank lines.
    blocks = F.split(strip(text), r"(?U)\n\s*\n")

    def read(rows: Column, at: Column) -> Column:
        timing = F.get(rows, at - 1)
        body = F.filter(F.slice(rows, at + 1, F.size(rows)), lambda x: ~x.rlike(f"(?U){DIGITS}"))
        return F.when(
            at > 0,
            F.struct(
                # One of the two forms matched; the groups of the other are empty.
                parse_time(F.concat(*[F.regexp_extract(timing, _TIMING, g) for g in (1, 3)])).alias("start"),
                parse_time(F.concat(*[F.regexp_extract(timing, _TIMING, g) for g in (2, 4)])).alias("end"),
                strip(F.array_join(body, " ")).alias("text"),
            ),
        )

    def cue(block: Column) -> Column:
        kept = F.filter(
            F.transform(lines(block), strip), lambda x: (x != "") & (F.upper(x) != "WEBVTT")
        )
        return let(
            kept,
            lambda rows: let(
                F.array_position(F.transform(rows, lambda x: x.rlike(_TIMING)), True).cast("int"),
                lambda at: read(rows, at),
            ),
        )

    found = F.transform(blocks, cue)
    good = F.filter(found, lambda c: c.isNotNull() & (c["text"] != "") & (c["end"] > c["start"]))
    placed = F.transform(good, lambda c, i: F.struct(c["start"].alias("start"), c["end"].alias("end"), i.alias("i"), c["text"].alias("text")))
    return F.array_sort(placed)


def subtitle_segments(files: DataFrame) -> DataFrame:
    """Segments of timed files (video_id, path, text); other files give none."""
    return (
        files.where(F.col("path").rlike(TIMED_SUFFIX))
        .select("video_id", F.posexplode(cues(F.col("text"))).alias("seq", "c"))
        .select("video_id", F.col("seq").cast("long").alias("seq"), "c.text", "c.start", "c.end")
    )


def subtitle_full_text(files: DataFrame) -> DataFrame:
    """Full text per file (video_id, path, text): cue texts by line for timed files, empty
    without a valid cue; the raw text for others. A file is one row already."""
    by_line = F.array_join(F.transform(cues(F.col("text")), lambda c: c["text"]), "\n")
    text = F.when(F.col("path").rlike(TIMED_SUFFIX), F.coalesce(by_line, F.lit(""))).otherwise(F.col("text"))
    return files.select("video_id", "path", text.alias("text"))


RECOGNITION = "transcripts array<struct<sentences:array<struct<text:string,begin_time:double,end_time:double>>>>"


def recognised_segments(results: DataFrame) -> DataFrame:
    """Segments of speech-recognition results (video_id, index, start_sec, result).

    Only the first transcript counts; sentence times are in ms from the start of
    the piece. ``position`` orders the sentences within their piece.
    """
    doc = F.from_json("result", RECOGNITION)
    sentences = F.get(doc["transcripts"], F.lit(0))["sentences"]
    rows = results.select("video_id", "index", "start_sec", F.posexplode(sentences).alias("position", "s"))

    def at(field: str) -> Column:
        return F.coalesce(F.col(f"s.{field}"), F.lit(0.0)) / 1000.0 + F.col("start_sec")

    return rows.where(strip(F.coalesce("s.text", F.lit(""))) != "").select(
        "video_id", "index", "position", strip(F.col("s.text")).alias("text"),
        at("begin_time").alias("start"), at("end_time").alias("end"),
    )


def timed_transcript(payloads: DataFrame) -> DataFrame:
    """Rows of ``content[]{text, offset, duration}`` payloads (video_id, body), in ms."""
    listed = F.from_json("body", "content array<struct<text:string,offset:double,duration:double>>")["content"]
    rows = payloads.select("video_id", F.posexplode(listed).alias("position", "c"))
    text = strip(F.replace(F.coalesce("c.text", F.lit("")), F.lit(SPEAKER_MARK), F.lit("")))
    start = F.coalesce("c.offset", F.lit(0.0)) / 1000.0
    return rows.select(
        "video_id", "position", text.alias("text"), start.alias("start"),
        (start + F.greatest(F.coalesce("c.duration", F.lit(0.0)) / 1000.0, F.lit(LEAST_SECONDS))).alias("end"),
    ).where("text <> ''")


TRACKS = "data struct<subtitle:struct<subtitles:array<struct<lan:string,lan_doc:string,subtitle_url:string,url:string>>>>"


def subtitle_tracks(payloads: DataFrame) -> DataFrame:
    """Usable tracks of track-list payloads (video_id, body), 1-based by position."""
    listed = F.from_json("body", TRACKS)["data"]["subtitle"]["subtitles"]

    def clean(value: Column) -> Column:
        return F.nullif(strip(value), F.lit(""))

    def track(t: Column) -> Column:
        raw = clean(F.coalesce(F.nullif(t["subtitle_url"], F.lit("")), t["url"]))
        return F.struct(
            F.when(F.startswith(raw, F.lit("//")), F.concat(F.lit("https:"), raw)).otherwise(raw).alias("url"),
            clean(t["lan"]).alias("lan"),
            clean(t["lan_doc"]).alias("lan_doc"),
        )

    usable = F.filter(F.transform(listed, track), lambda t: t["url"].isNotNull())
    number = (F.col("p") + 1).cast("string")
    return (
        payloads.select("video_id", F.posexplode(usable).alias("p", "t"))
        .select(
            "video_id",
            (F.col("p") + 1).alias("position"),
            F.coalesce("t.lan", "t.lan_doc", F.concat(F.lit(TRACK_ID), number)).alias("id"),
            F.coalesce("t.lan_doc", "t.lan", F.concat(F.lit(TRACK_LABEL), number)).alias("label"),
            F.coalesce("t.lan", F.lit("")).alias("lan"),
            "t.url",
        )
    )


def subtitle_body(body: Column) -> Column:
    """Subtitle rows from the first of four places that holds a list."""
    obj = F.try_parse_json(body)
    places = [
        F.try_variant_get(obj, path, "array<variant>")
        for path in ("$.body", "$.data.body", "$.result.body", "$.content")
    ]
    return F.transform(
        F.coalesce(*places),
        lambda r: F.struct(
            F.try_variant_get(r, "$.content", "string").alias("content"),
            F.try_variant_get(r, "$.from", "double").alias("from"),
            F.try_variant_get(r, "$.to", "double").alias("to"),
        ),
    )


def body_segments(payloads: DataFrame) -> DataFrame:
    """Segments of subtitle bodies; an end that is missing or too early is start + 3 s."""
    rows = payloads.select("video_id", F.posexplode(subtitle_body(F.col("body"))).alias("position", "r"))
    start = F.coalesce("r.from", F.lit(0.0))
    return rows.select(
        "video_id", "position", strip(F.coalesce("r.content", F.lit(""))).alias("text"),
        start.alias("start"),
        F.when(F.col("r.to") > start, F.col("r.to")).otherwise(start + OPEN_CUE_SECONDS).alias("end"),
    ).where("text <> ''")
