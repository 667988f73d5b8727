"""The driver tables read as lecture data.

``events`` gives one transcript segment, one frame and one frame request per row
(a user is a video), ``documents`` transcript texts, ``conversations`` chat
sessions and subtitle texts, ``embeddings`` frame hashes, ``pages`` links.
Missing values, malformed answers and link shapes that the tables lack are
derived from the row ids, the same way in ``sqlparts`` definitions below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import spread
from workload.sqlparts import define

SEGMENT_MINUTES = 2880.0
CHUNK_SECONDS = 172800
FRAMES_PER_CHUNK = 3
TOLERANCE = 1800.0


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def read_spread(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spread(read(spark, sf, name))


def read_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The documents, spread over the cores: their texts are long."""
    return read_spread(spark, sf, "documents")


MS = "timestampdiff(MILLISECOND, timestamp_ntz'2024-01-01 00:00:00', ts)"
MS_SQL = "((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 1000)"


def segments(spark: SparkSession, sf: str) -> DataFrame:
    start = F.expr(f"CASE WHEN event_id % 97 = 13 THEN NULL ELSE {MS} / 1000D END")
    return read(spark, sf, "events").select(
        F.col("user_id").alias("video_id"),
        F.col("event_id").alias("seq"),
        F.expr("event_type || ' #' || event_id || ' ' || props").alias("text"),
        start.alias("start"),
        F.when(F.expr("event_id % 89 <> 5"), start + F.col("value")).alias("end"),
    )


define("segs", f"""
SELECT user_id AS video_id, event_id AS seq,
       event_type || ' #' || event_id || ' ' || props AS text,
       CASE WHEN event_id % 97 = 13 THEN NULL ELSE {MS_SQL} / 1000e0 END AS start,
       CASE WHEN event_id % 97 = 13 OR event_id % 89 = 5 THEN NULL
            ELSE {MS_SQL} / 1000e0 + value END AS "end"
FROM events""")
define("starts", "SELECT DISTINCT video_id, start FROM segs WHERE start IS NOT NULL")
define("chain", f"""
SELECT video_id, 0 AS chunk_index, min(start) AS chunk_start FROM starts GROUP BY video_id
UNION ALL
SELECT c.video_id, c.chunk_index + 1, min(s.start)
FROM chain c JOIN starts s ON s.video_id = c.video_id AND s.start - c.chunk_start >= {CHUNK_SECONDS}
GROUP BY c.video_id, c.chunk_index""")
define("members", f"""
SELECT s.video_id, s.seq, s.text, s.start, s."end", c.chunk_index,
       row_number() OVER (PARTITION BY s.video_id, c.chunk_index ORDER BY s.start, s.seq) AS srt_id
FROM segs s JOIN chain c ON s.video_id = c.video_id
 AND s.start >= c.chunk_start AND s.start - c.chunk_start < {CHUNK_SECONDS}""")
define("chunks", """
SELECT video_id, chunk_index, min(start) AS start_sec,
       arg_max(coalesce("end", start), srt_id) AS end_sec, count(*) AS n_segments
FROM members GROUP BY video_id, chunk_index""")


def frames(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select(
        F.col("user_id").alias("video_id"),
        F.col("event_id").alias("frame_id"),
        F.expr("'src/frame_' || event_id || '.jpg'").alias("path"),
        F.expr(f"{MS} / 1000D + (event_id % 1000) * 60").alias("timestamp_sec"),
        F.expr("CASE WHEN event_id % 2 = 0 THEN 'scene' ELSE 'interval' END").alias("source"),
    )


define("frames", f"""
SELECT user_id AS video_id, event_id AS frame_id, 'src/frame_' || event_id || '.jpg' AS path,
       {MS_SQL} / 1000e0 + (event_id % 1000) * 60 AS timestamp_sec,
       CASE WHEN event_id % 2 = 0 THEN 'scene' ELSE 'interval' END AS source
FROM events""")
define("placed", """
SELECT * EXCLUDE (r) FROM (
  SELECT f.*, c.chunk_index,
         (c.start_sec <= f.timestamp_sec AND f.timestamp_sec < c.end_sec) AS matched,
         row_number() OVER (PARTITION BY f.video_id, f.frame_id ORDER BY
           CASE WHEN c.start_sec <= f.timestamp_sec AND f.timestamp_sec < c.end_sec THEN 0 ELSE 1 END,
           CASE WHEN c.start_sec <= f.timestamp_sec AND f.timestamp_sec < c.end_sec THEN c.chunk_index::DOUBLE
                ELSE abs(f.timestamp_sec - (c.start_sec + c.end_sec) / 2) END,
           c.chunk_index) AS r
  FROM frames f JOIN chunks c ON f.video_id = c.video_id) WHERE r = 1""")
define("capped", f"""
SELECT * EXCLUDE (pos, n) FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id, chunk_index ORDER BY timestamp_sec, frame_id) - 1 AS pos,
         count(*) OVER (PARTITION BY video_id, chunk_index) AS n FROM placed)
WHERE n <= {FRAMES_PER_CHUNK} OR list_contains(
  list_transform(range(0, {FRAMES_PER_CHUNK}),
                 lambda j: CAST(round_even(j * ((n - 1) / {FRAMES_PER_CHUNK - 1}e0), 0) AS BIGINT)), pos)""")


def requests(spark: SparkSession, sf: str, members: DataFrame) -> DataFrame:
    """One frame request per placed segment."""
    return members.select(
        "video_id",
        "chunk_index",
        F.expr("'a' || seq").alias("anchor_id"),
        F.expr("CAST(seq % 9 AS INT)").alias("srt_id"),
        F.expr("start + (seq % 7) * 500").alias("timestamp"),
        F.expr("CASE WHEN seq % 2 = 0 THEN 'reuse' ELSE 'new_capture' END").alias("request_type"),
        F.expr("CASE WHEN seq % 2 = 0 THEN 'src/frame_' || seq || '.jpg' END").alias("source_frame_path"),
        F.lit("").alias("reason"),
    )


define("requests", """
SELECT video_id, chunk_index, 'a' || seq AS anchor_id, CAST(seq % 9 AS INTEGER) AS srt_id,
       start + (seq % 7) * 500 AS timestamp,
       CASE WHEN seq % 2 = 0 THEN 'reuse' ELSE 'new_capture' END AS request_type,
       CASE WHEN seq % 2 = 0 THEN 'src/frame_' || seq || '.jpg' END AS source_frame_path,
       '' AS reason
FROM members""")
