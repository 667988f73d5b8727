"""Frame files, session tables, manifests and reports on storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.model_output import image_type
from lectern.functions.text import frame_name_time
from lectern.operators.inference import log_to_keep
from lectern.sources.text_sink import EMPTY_NAME, NO_NAME, TextDocuments

MANIFEST = (
    "video_id string, mode string, input_sha string, input_size bigint, subtitle_sha string, "
    "subtitle_size bigint, config_hash string, frames_digest string, cache_key string"
)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, size and time of files; the content column is never read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    )


def frames_from_listing(listing: DataFrame) -> DataFrame:
    """Frame rows out of a file listing; times come from the names."""
    return listing.withColumn("timestamp_sec", frame_name_time(F.col("path"))).withColumn(
        "source", F.lit("heuristic")
    )


def scan_frames(spark: SparkSession, path: str) -> DataFrame:
    return frames_from_listing(list_files(spark, path, "*.jpg"))


def encode_images(files: DataFrame) -> DataFrame:
    """Base64 text and media type of image files (path, content)."""
    # base64 may break its output into lines.
    data = F.translate(F.base64("content"), "\r\n", "")
    return files.select("path", data.alias("data"), image_type(F.col("path")).alias("mime"))


def read_sessions(spark: SparkSession, sessions: str, messages: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(sessions), spark.read.parquet(messages)


def write_texts(parts: DataFrame, path: str) -> None:
    """Documents as JSON rows (video_id, part, text), fit for any number of videos."""
    parts.select("video_id", "part", "text").write.mode("overwrite").json(path)


def write_text_files(parts: DataFrame, path: str, suffix: str) -> None:
    """Documents as plain text, one file ``<video_id>.<suffix>`` each.

    A task writes the files of many videos; the parts of a document reach its file in order.
    """
    parts.sparkSession.dataSource.register(TextDocuments)
    rows = parts.select(F.col("video_id").cast("string").alias("name"), "part", "text")
    rows = rows.repartition("name").sortWithinPartitions("name", "part").select("name", "text")
    rows.write.format("text_documents").mode("overwrite").option("suffix", suffix).save(path)


def read_text_files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(video_id, text) of written documents; empty files are left out."""
    spark.dataSource.register(TextDocuments)
    files = spark.read.format("text_documents").option("suffix", suffix).load(path)
    name = F.col("name")
    return files.select(
        F.when(name == EMPTY_NAME, "").when(name != NO_NAME, F.try_url_decode(name)).alias("video_id"), "text"
    )


def write_reports(pages: DataFrame, path: str) -> None:
    pages.write.mode("overwrite").json(path)


def append_log(log: DataFrame, path: str, only_failures: bool = True) -> None:
    """Raw model answers: failures always, successes only for an audit."""
    log_to_keep(log, only_failures).write.mode("append").json(path)


def write_manifests(manifests: DataFrame, path: str) -> None:
    manifests.write.mode("overwrite").json(path)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Readable manifests; lines that are not one are dropped."""
    return (
        spark.read.schema(MANIFEST + ", broken string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "broken")
        .json(path)
        .where("broken IS NULL AND video_id IS NOT NULL")
        .drop("broken")
    )
