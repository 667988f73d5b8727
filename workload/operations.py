"""Run reports, sessions, caches and checkpoints."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lectern.operators import reuse, runs, sessions
from lectern.session import scratch_path
from lectern.sources import files as file_io
from workload import tables as t
from workload.sqlparts import define, query

BUCKET = "CASE event_type WHEN 'error' THEN 'failed_segments' WHEN 'view' THEN 'fallbacks' WHEN 'click' THEN 'skipped_frames' WHEN 'purchase' THEN 'cache_hits' ELSE 'repairs' END"
# Most runs only see harmless events, so that all three statuses occur.
CALM = f"CASE WHEN user_id % 3 > 0 AND event_type IN ('error', 'view', 'click') THEN 'repairs' ELSE {BUCKET} END"


def run_events(spark, sf):
    return t.read(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.expr(CALM).alias("bucket"),
        F.expr("'stage_' || (event_id % 4)").alias("stage"), F.expr("'[' || event_type || '] ' || props").alias("message"),
        F.create_map(F.lit("index"), F.col("event_id").cast("string")).alias("detail"),
        # Whole minutes, so that equal times occur.
        F.date_trunc("DAY", F.col("ts")).cast("timestamp").alias("ts"),
    )


define("run_events", f"""
SELECT user_id AS run_id, event_id AS seq, {CALM} AS bucket, 'stage_' || (event_id % 4) AS stage,
       '[' || event_type || '] ' || props AS message, date_trunc('day', ts) AS ts FROM events""")


def known_runs(spark, sf):
    """Runs, some with an error, some without any event."""
    rows = t.read(spark, sf, "events").select(F.explode(F.array("user_id", F.col("user_id") + 100000)).alias("run_id")).distinct()
    return rows.withColumn("error", F.when(F.col("run_id") % 10 == 7, F.concat(F.lit("boom "), F.col("run_id").cast("string"))))


define("known_runs", """
SELECT DISTINCT run_id, CASE WHEN run_id % 10 = 7 THEN 'boom ' || run_id END AS error
FROM (SELECT user_id AS run_id FROM events UNION ALL SELECT user_id + 100000 FROM events)""")


def a6(spark, sf):
    return runs.bucket_counts(run_events(spark, sf))


A6 = query("SELECT run_id, " + ", ".join(f"count(*) FILTER (WHERE bucket = '{b}') AS {b}" for b in runs.BUCKETS) + " FROM run_events GROUP BY run_id")


def a7(spark, sf):
    return runs.run_status(run_events(spark, sf), known_runs(spark, sf))


A7 = query("""
SELECT r.run_id, coalesce(d.degraded, false) AS degraded,
       CASE WHEN error IS NOT NULL THEN 'error' WHEN d.degraded THEN 'degraded' ELSE 'success' END AS status
FROM known_runs r LEFT JOIN (SELECT run_id, bool_or(bucket IN ('failed_segments', 'fallbacks', 'skipped_frames')) AS degraded
  FROM run_events GROUP BY run_id) d ON r.run_id = d.run_id""")


def t7(spark, sf):
    return runs.warnings(run_events(spark, sf)).select("run_id", "position", "bucket", "message")


T7 = query("""
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY ts,
  CASE bucket WHEN 'failed_segments' THEN 1 WHEN 'fallbacks' THEN 2 ELSE 3 END, seq) AS position, bucket, message
FROM run_events WHERE bucket IN ('failed_segments', 'fallbacks', 'skipped_frames')""")


def u2(spark, sf):
    events = run_events(spark, sf)
    parts = [events.where(F.col("bucket") == b) for b in runs.DEGRADING]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("run_id", "seq", "bucket", "stage")


U2 = query("SELECT run_id, seq, bucket, stage FROM run_events WHERE bucket IN ('failed_segments', 'fallbacks', 'skipped_frames')")


def u3(spark, sf):
    events = run_events(spark, sf)
    return runs.merge_events(events.where("seq % 2 = 0"), events.where("seq % 2 = 1")).select("run_id", "seq", "bucket")


def s12(spark, sf):
    """Reports written as JSON and read back: events per bucket in order."""
    path = scratch_path(spark, "reports")
    file_io.write_reports(runs.report_pages(run_events(spark, sf), known_runs(spark, sf)), path)
    event = "array<struct<seq:bigint,stage:string,message:string>>"
    counts = "struct<" + ",".join(f"{b}:bigint" for b in runs.BUCKETS) + ">"
    read = spark.read.schema(
        f"run_id bigint, page int, status string, error string, summary {counts}, " + ", ".join(f"{b} {event}" for b in runs.BUCKETS)
    ).json(path)
    seqs = [
        F.array_join(F.transform(b, lambda e: e["seq"].cast("string")), ",").alias(b) for b in runs.BUCKETS
    ]
    return read.select("run_id", "page", "status", "error", F.col("summary.repairs").alias("n_repairs"), *seqs)


S12 = query("""
SELECT r.run_id, 0 AS page, r.error,
       CASE WHEN error IS NOT NULL THEN 'error' WHEN coalesce(d, false) THEN 'degraded' ELSE 'success' END AS status,
       coalesce(n_repairs, 0) AS n_repairs, """ + ", ".join(f"coalesce({b}, '') AS {b}" for b in runs.BUCKETS) + """
FROM known_runs r LEFT JOIN (
  SELECT run_id, bool_or(bucket IN ('failed_segments', 'fallbacks', 'skipped_frames')) AS d,
         count(*) FILTER (WHERE bucket = 'repairs') AS n_repairs, """ + ", ".join(
    f"string_agg('' || seq, ',' ORDER BY seq) FILTER (WHERE bucket = '{b}') AS {b}" for b in runs.BUCKETS
) + """ FROM run_events GROUP BY run_id) e ON r.run_id = e.run_id""")


# --- sessions ---------------------------------------------------------------------


def chat(spark, sf):
    """(sessions, messages): a conversation is a session, plus one empty one for each."""
    turns = t.read(spark, sf, "conversations")
    each = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    own = F.explode(F.array(F.lit(0), F.lit(1))).alias("e")
    all_sessions = each.select("conv_id", "last", own).select(
        (F.col("conv_id") + F.col("e") * 1000000).alias("id"),
        F.when(F.col("conv_id") % 5 > 0, F.concat(F.lit("chat "), F.col("conv_id").cast("string"))).alias("title"),
        F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("t"), F.col("conv_id").cast("string"))).alias("thread_id"),
        (F.lit(1700000000) + F.col("conv_id") * 100).cast("long").alias("created_at"),
        (F.lit(1700000000) + F.col("conv_id") * 100 + F.col("last")).cast("long").alias("updated_at"),
    )
    messages = turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("session_id"), "role",
        F.col("text").alias("content"),
        F.expr("CASE turn % 4 WHEN 0 THEN '{\"call\": ' || turn || '}' WHEN 1 THEN 'not json' WHEN 2 THEN '' END").alias("tool_calls"),
        F.expr("CASE WHEN turn % 3 = 0 THEN '[' || turn || ']' END").alias("reasoning"),
        (F.lit(1700000000) + F.col("conv_id") * 100 + F.floor(F.col("turn") / 2)).cast("long").alias("created_at"),
    )
    return all_sessions, messages


define("sessions", """
SELECT conv_id + e * 1000000 AS id, CASE WHEN conv_id % 5 > 0 THEN 'chat ' || conv_id END AS title,
       CASE WHEN conv_id % 2 = 0 THEN 't' || conv_id END AS thread_id, 1700000000 + conv_id * 100 AS created_at,
       1700000000 + conv_id * 100 + last AS updated_at
FROM (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id), (SELECT unnest([0, 1]) AS e)""")
define("messages", """
SELECT conv_id * 1000 + turn AS id, conv_id AS session_id, role, text AS content, turn,
       1700000000 + conv_id * 100 + turn // 2 AS created_at FROM conversations""")


def s9(spark, sf):
    """Session and message tables written and scanned back."""
    a, b = scratch_path(spark, "sessions"), scratch_path(spark, "messages")
    for frame, path in zip(chat(spark, sf), (a, b)):
        frame.write.parquet(path)
    s, m = file_io.read_sessions(spark, a, b)
    return s.select("id", "title", F.lit("session").alias("kind")).unionByName(
        m.select("id", F.col("role").alias("title"), F.lit("message").alias("kind"))
    )


def j16(spark, sf):
    return sessions.with_messages(*chat(spark, sf)).select("id", "title", "message_id", "role", "message_created_at")


def a8(spark, sf):
    return sessions.listing(*chat(spark, sf)).select("id", "title", "updated_at", "message_count")


A8 = query("""
SELECT s.id, s.title, s.updated_at, count(m.id) AS message_count
FROM sessions s LEFT JOIN messages m ON s.id = m.session_id GROUP BY s.id, s.title, s.updated_at""")


def t6(spark, sf):
    rows = sessions.newest_first(sessions.listing(*chat(spark, sf)))
    return rows.select("id", "updated_at", "position")


def a9(spark, sf):
    return sessions.totals(*chat(spark, sf))


def a9_roles(spark, sf):
    return sessions.messages_by_role(chat(spark, sf)[1])


# Fractions of a second that are part of some times.
PART = "CASE {x} % 4 WHEN 1 THEN 0.75 WHEN 2 THEN 0.000125 ELSE 0 END"


def a10(spark, sf):
    s, m = chat(spark, sf)
    late = [F.col("created_at") + F.expr(PART.format(x="id")).cast("double")]
    pages = sessions.export(s.withColumn("created_at", *late), m.withColumn("created_at", *late))
    return pages.select(
        "id", "page", "title", "thread_id", "created_at", "updated_at",
        F.posexplode_outer("messages").alias("place", "m"),
    ).select(
        "id", "page", "title", "thread_id", "created_at", "updated_at", "m.position", "m.role", "m.content",
        # As the JSON writer prints them: values, not quoted texts.
        F.when(F.col("m").isNotNull(), F.to_json(F.struct("m.tool_calls", "m.reasoning"))).alias("nested"),
        F.col("m.created_at").alias("sent_at"),
    )


ISO = "strftime(make_timestamp({x} * 1000000), '%Y-%m-%dT%H:%M:%S')"
ISO_PART = "{iso} || CASE {x} % 4 WHEN 1 THEN '.750000' WHEN 2 THEN '.000125' ELSE '' END"
A10 = query(f"""
SELECT s.id, 0 AS page, s.title, s.thread_id, {ISO_PART.format(iso=ISO.format(x='s.created_at'), x='s.id')} AS created_at,
       {ISO.format(x='s.updated_at')} AS updated_at,
       CASE WHEN m.id IS NOT NULL THEN row_number() OVER (PARTITION BY s.id ORDER BY m.created_at + {PART.format(x='m.id')}, m.id) END AS position,
       m.role, m.content,
       CASE WHEN m.id IS NOT NULL THEN '{{' || concat_ws(',', CASE WHEN m.turn % 4 = 0 THEN '"tool_calls":{{"call":' || m.turn || '}}' END,
         CASE WHEN m.turn % 3 = 0 THEN '"reasoning":[' || m.turn || ']' END) || '}}' END AS nested,
       {ISO_PART.format(iso=ISO.format(x='m.created_at'), x='m.id')} AS sent_at
FROM sessions s LEFT JOIN messages m ON s.id = m.session_id""")


def _deleted(spark, sf):
    s, m = chat(spark, sf)
    ids = s.where("title IS NULL").select("id")
    return sessions.delete(s, m, ids)


def a15(spark, sf):
    s, m, _ = _deleted(spark, sf)
    return s.select("id", F.lit("session").alias("kind")).unionByName(m.select("id", F.lit("message").alias("kind")))


A15 = query("""
SELECT id, 'session' AS kind FROM sessions WHERE title IS NOT NULL
UNION ALL SELECT id, 'message' FROM messages WHERE session_id NOT IN (SELECT id FROM sessions WHERE title IS NULL)""")


def a15_counts(spark, sf):
    return _deleted(spark, sf)[2]


A15_COUNTS = query("""
SELECT s.id, count(m.id) AS deleted_messages FROM sessions s LEFT JOIN messages m ON s.id = m.session_id
WHERE s.title IS NULL GROUP BY s.id""")

# --- caches -----------------------------------------------------------------------------


# Names and numbers whose JSON needs escapes and exponents.
MODEL_NAMES = ["tiny", "转写-大", 'say "hi"', "tab\tend\\", "é\U0001d11e\x7f", ""]
THRESHOLDS = [0.4, 1e-05, 1e16, 123456789.125, 0.1 + 0.2, 2.0]


def a5(spark, sf):
    """Content hashes of the document texts, and hashes of settings with names and numbers of many kinds."""
    rows = t.read(spark, sf, "documents")
    files = rows.select(
        F.expr("'in/' || doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"),
        F.length(F.encode("text", "UTF-8")).cast("long").alias("length"),
    )
    names, numbers = (F.array(*[F.lit(x) for x in values]) for values in (MODEL_NAMES, THRESHOLDS))
    k = F.col("doc_id") % len(MODEL_NAMES)
    configs = rows.select(
        F.expr("'config/' || doc_id").alias("path"), F.lit(None).cast("long").alias("size"),
        reuse.config_hash(
            F.lit("keyframe"), F.col("lang"), F.get(names, k), scene=F.get(numbers, k), similarity=F.lit(0.95),
            max_frames=F.col("doc_id") % 7,
        ).alias("sha"),
    )
    return reuse.content_hash(files).unionByName(configs)


def _config(k: int) -> str:
    """SQL for the JSON of the settings with name and number ``k``."""
    name, number = (json.dumps(x[k]).replace("'", "''") for x in (MODEL_NAMES, THRESHOLDS))
    return (
        f"""'{{"asr_model": {name}, "asr_provider": "' || coalesce(lang, '') || '", "heuristic_max_frames": ' || (doc_id % 7)"""
        f""" || ', "heuristic_scene_threshold": {number}, "heuristic_similarity_threshold": 0.95, "mode": "keyframe"}}'"""
    )


A5 = f"""
SELECT 'in/' || doc_id AS path, octet_length(encode(text)) AS size, substr(sha256(text), 1, 16) AS sha FROM documents
UNION ALL SELECT 'config/' || doc_id, NULL, substr(sha256(CASE doc_id % {len(MODEL_NAMES)}
  {' '.join(f'WHEN {k} THEN {_config(k)}' for k in range(len(MODEL_NAMES)))} END), 1, 16) FROM documents"""


def manifests(spark, sf, current: bool):
    """Manifests of the parts; the current side differs in some of them."""
    rows = t.read(spark, sf, "part")
    k = F.col("p_partkey")
    moved = (k % 7 == 3) if current else F.lit(False)
    mode = F.when(k % 2 == 0, "subtitle").otherwise("keyframe")
    frames_max = F.lit(200) if not current else F.when(k % 11 == 5, 100).otherwise(200)
    config = F.when(
        mode == "subtitle", reuse.config_hash(F.lit("subtitle"), F.col("p_brand"), F.col("p_type"))
    ).otherwise(
        reuse.config_hash(F.lit("keyframe"), scene=F.lit(0.4), similarity=F.lit(0.95), max_frames=frames_max)
    )
    digest = F.when(k % 3 == 0, F.concat(F.lit("d"), (k + (F.lit(1) if current else F.lit(0))).cast("string")))
    if current:
        digest = F.when(k % 2 == 0, digest)
    out = rows.select(
        k.alias("video_id"), mode.alias("mode"),
        F.when(moved, "moved").otherwise(reuse.short_hash(F.col("p_name"))).alias("input_sha"),
        F.col("p_size").cast("long").alias("input_size"),
        F.when(k % 4 == 0, reuse.short_hash(F.col("p_type"))).alias("subtitle_sha"),
        F.when(k % 4 == 0, F.lit(9).cast("long")).alias("subtitle_size"),
        config.alias("config_hash"), digest.alias("frames_digest"),
    )
    # Each side lacks some videos the other one has.
    return out.where(k % 13 != (5 if current else 6))


DIGEST = "CASE WHEN k % 3 = 0 THEN 'd' || (k + {d}) END"
CONFIG_SQL = """substr(sha256(CASE WHEN k % 2 = 0
 THEN '{"asr_model": "' || p_type || '", "asr_provider": "' || p_brand || '", "heuristic_max_frames": 0, "heuristic_scene_threshold": 0.0, "heuristic_similarity_threshold": 0.0, "mode": "subtitle"}'
 ELSE '{"asr_model": "", "asr_provider": "", "heuristic_max_frames": ' || {m} || ', "heuristic_scene_threshold": 0.4, "heuristic_similarity_threshold": 0.95, "mode": "keyframe"}' END), 1, 16)"""
define("manifest_rows", """
SELECT *, p_partkey AS k, substr(sha256(p_name), 1, 16) AS sha, p_partkey % 13 <> 6 AS has_old, p_partkey % 13 <> 5 AS has_new FROM part""")
KEY_SQL = """substr(sha256('input:' || {sha} || ':' || p_size
 || CASE WHEN k % 4 = 0 THEN '|subtitle:' || substr(sha256(p_type), 1, 16) || ':9' ELSE '' END
 || '|config:' || {config} || {frames}), 1, 16)"""
SAME_FRAMES = "CASE WHEN has_old AND has_new AND k % 3 = 0 AND k % 2 = 0 THEN '|frames:d' || (k + 1) ELSE '' END"
OLD_KEY = KEY_SQL.format(sha="sha", config=CONFIG_SQL.replace("{m}", "200"), frames=SAME_FRAMES)
NEW_KEY = KEY_SQL.format(
    sha="CASE WHEN k % 7 = 3 THEN 'moved' ELSE sha END",
    config=CONFIG_SQL.replace("{m}", "CASE WHEN k % 11 = 5 THEN 100 ELSE 200 END"), frames=SAME_FRAMES,
)


def j17(spark, sf):
    out = reuse.validate_manifests(manifests(spark, sf, False), manifests(spark, sf, True))
    missing = F.col("state")
    return out.select(
        "video_id", "mode", "state", F.when(missing != "new", F.col("stored_key")).alias("stored_key"),
        F.when(missing != "orphan", F.col("current_key")).alias("current_key"),
    )


J17 = query(f"""
SELECT k AS video_id, CASE WHEN k % 2 = 0 THEN 'subtitle' ELSE 'keyframe' END AS mode,
  CASE WHEN NOT has_old THEN 'new' WHEN NOT has_new THEN 'orphan'
       WHEN k % 7 = 3 OR (k % 2 = 1 AND k % 11 = 5) THEN 'stale' ELSE 'hit' END AS state,
  CASE WHEN has_old THEN {OLD_KEY} END AS stored_key, CASE WHEN has_new THEN {NEW_KEY} END AS current_key
FROM manifest_rows""")


def s14(spark, sf):
    """Manifests written as JSON and read back, an unreadable line among them."""
    path = scratch_path(spark, "manifests")
    rows = manifests(spark, sf, False)
    key = reuse.cache_key(*[F.col(c) for c in ("input_sha", "input_size", "subtitle_sha", "subtitle_size", "config_hash", "frames_digest")])
    file_io.write_manifests(rows.withColumn("cache_key", key), path)
    rows.where("video_id % 50 = 0").select(F.concat(F.lit('{"video_id": "'), F.col("mode")).alias("value")).write.mode("append").text(path)
    return file_io.read_manifests(spark, path).select(
        F.col("video_id").cast("long").alias("video_id"), "mode", "input_sha", "input_size", "frames_digest", "cache_key"
    )


S14 = query(f"""
SELECT k AS video_id, CASE WHEN k % 2 = 0 THEN 'subtitle' ELSE 'keyframe' END AS mode, sha AS input_sha,
       CAST(p_size AS BIGINT) AS input_size, {DIGEST.format(d=0)} AS frames_digest,
       {KEY_SQL.format(sha='sha', config=CONFIG_SQL.replace('{m}', '200'), frames="CASE WHEN k % 3 = 0 THEN '|frames:d' || k ELSE '' END")} AS cache_key
FROM manifest_rows WHERE has_old""")


def pieces(spark, sf):
    """Audio pieces (one per message) and the checkpoint that covers some of them."""
    turns = t.read(spark, sf, "conversations")
    all_pieces = turns.select(
        F.col("conv_id").alias("video_id"), F.col("turn").cast("int").alias("index"),
        (F.col("turn") * 300.0).alias("start_sec"), F.lit(300.0).alias("duration_sec"),
    )
    checkpoint = turns.where("(conv_id + turn) % 4 <> 3").select(
        F.col("conv_id").alias("video_id"), F.col("turn").cast("int").alias("index"),
        F.expr("CASE (conv_id + turn) % 4 WHEN 0 THEN 'submitted' ELSE 'done' END").alias("status"),
        F.expr("'task' || turn").alias("task_id"),
        F.when(F.expr("(conv_id + turn) % 4 = 1"), F.col("text")).alias("result"),
    )
    return all_pieces, checkpoint


def j13(spark, sf):
    p, c = pieces(spark, sf)
    return reuse.pending_pieces(p, c).select("video_id", "index", "start_sec")


J13 = """
SELECT conv_id AS video_id, CAST(turn AS INTEGER) AS index, turn * 300e0 AS start_sec FROM conversations
WHERE (conv_id + turn) % 4 IN (0, 3)"""


def j13_restored(spark, sf):
    return reuse.restored_results(*pieces(spark, sf)).select("video_id", "index", "task_id", "result")


J13_RESTORED = """
SELECT conv_id AS video_id, CAST(turn AS INTEGER) AS index, 'task' || turn AS task_id, text AS result FROM conversations
WHERE (conv_id + turn) % 4 = 1 AND text <> ''"""


def j13_poll(spark, sf):
    return reuse.pieces_to_poll(*pieces(spark, sf)).select("video_id", "index", "task_id")


J13_POLL = """
SELECT conv_id AS video_id, CAST(turn AS INTEGER) AS index, 'task' || turn AS task_id FROM conversations
WHERE (conv_id + turn) % 4 = 2 OR (conv_id + turn) % 4 = 1 AND coalesce(text, '') = ''"""


def j14(spark, sf):
    p, c = pieces(spark, sf)
    return reuse.missing_pieces(p, c.where("status = 'done'"))


J14 = """
SELECT conv_id AS video_id, count(*) AS total_chunks, count(*) FILTER (WHERE (conv_id + turn) % 4 IN (1, 2)) AS succeeded_chunks,
       count(*) FILTER (WHERE (conv_id + turn) % 4 IN (0, 3)) AS missing_chunks
FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE (conv_id + turn) % 4 IN (0, 3)) > 0"""

QUERIES = {
    "a6_bucket_counts": (a6, A6),
    "a7_run_status": (a7, A7),
    "t7_warnings": (t7, T7),
    "u2_warning_buckets": (u2, U2),
    "u3_merged_events": (u3, query("SELECT run_id, seq, bucket FROM run_events")),
    "s12_run_reports": (s12, S12),
    "s9_session_tables": (s9, query("SELECT id, title, 'session' AS kind FROM sessions UNION ALL SELECT id, role, 'message' FROM messages")),
    "j16_session_messages": (j16, query("""
SELECT s.id, s.title, m.id AS message_id, m.role, m.created_at AS message_created_at
FROM sessions s LEFT JOIN messages m ON s.id = m.session_id""")),
    "a8_message_counts": (a8, A8),
    "t6_newest_sessions": (t6, query("""
SELECT id, updated_at, row_number() OVER (ORDER BY updated_at DESC, id) AS position FROM sessions""")),
    "a9_totals": (a9, query("""
SELECT (SELECT count(*) FROM sessions) AS sessions, (SELECT min(created_at) FROM sessions) AS oldest,
       (SELECT max(updated_at) FROM sessions) AS newest, (SELECT count(*) FROM messages) AS messages""")),
    "a9_roles": (a9_roles, query("""
SELECT role, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, role) AS position FROM messages GROUP BY role""")),
    "a10_session_export": (a10, A10),
    "a15_cascade_delete": (a15, A15),
    "a15_deleted_counts": (a15_counts, A15_COUNTS),
    "a5_content_hashes": (a5, A5),
    "j17_cache_states": (j17, J17),
    "s14_manifests": (s14, S14),
    "j13_pending_pieces": (j13, J13),
    "j13_restored_results": (j13_restored, J13_RESTORED),
    "j13_pieces_to_poll": (j13_poll, J13_POLL),
    "j14_missing_pieces": (j14, J14),
}
