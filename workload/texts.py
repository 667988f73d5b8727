"""Transcript text, subtitle files, recognition results, times."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as fx
from lectern.operators import chunking, documents, reuse
from lectern.operators.ordering import ordered, ordinal
from lectern.session import scratch_path
from lectern.sources import files as file_io
from lectern.sources import subtitles
from workload import tables as t
from workload.sqlparts import define, query
from workload.timeline import srt_sql

# Asides, wide punctuation, repeated lines and sentence ends, added to each text.
DECORATION = "\n[音乐]，测试。完成！\n 重复行 \n重复行\n\n\n（旁白) 3.14  ok　end\n重复行"


def raw_texts(spark, sf):
    return t.read_texts(spark, sf).select(
        F.col("doc_id").alias("video_id"),
        F.concat("text", F.when(F.col("doc_id") % 2 == 0, F.lit(DECORATION)).otherwise("")).alias("text"),
    )


define("raw_texts", f"""
SELECT doc_id AS video_id,
       text || CASE WHEN doc_id % 2 = 0 THEN '{DECORATION}' ELSE '' END AS text FROM documents""")


def f1(spark, sf):
    return raw_texts(spark, sf).select("video_id", fx.clean_transcript(F.col("text")).alias("cleaned"))


STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
define("width", """
SELECT video_id, translate(regexp_replace(text, '[\\[【（(].*?[\\]】）)]', '', 'g'), '，。！？：；　', ',.!?:; ') AS text
FROM raw_texts""")
define("line_lists", f"""
SELECT video_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {STRIP.format(x='x')}),
                             lambda x: x <> '') AS l FROM width""")
define("collapsed", """
SELECT video_id, array_to_string(list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1]), chr(10)) AS text FROM line_lists""")
F1 = query(f"""
SELECT video_id, {STRIP.format(x="regexp_replace(regexp_replace(regexp_replace(text, '([。.!?！？])\\s*', '\\1' || chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g')")} AS cleaned
FROM collapsed""")


def w5(spark, sf):
    rows = F.filter(F.transform(fx.lines(F.col("text")), fx.strip), lambda x: x != "")
    return (
        raw_texts(spark, sf)
        .select("video_id", F.size(rows).alias("n_lines"), fx.collapse_repeats(rows).alias("kept"))
        .select("video_id", "n_lines", F.size("kept").alias("n_kept"), F.array_join("kept", "|").alias("kept"))
    )


define("plain_lines", f"""
SELECT video_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {STRIP.format(x='x')}),
                             lambda x: x <> '') AS l FROM raw_texts""")
W5 = query("""
SELECT video_id, CAST(len(l) AS INTEGER) AS n_lines,
       CAST(len(list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1])) AS INTEGER) AS n_kept,
       array_to_string(list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1]), '|') AS kept FROM plain_lines""")


def subtitle_files(spark, sf):
    """One subtitle file per message: header, a late cue, an early cue, a broken one."""
    body = F.regexp_replace("text", r"\s*\n\s*", "\n")
    return t.read(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("video_id"),
        F.concat(
            F.lit("subs/"), (F.col("conv_id") * 1000 + F.col("turn")).cast("string"),
            F.expr("CASE turn % 4 WHEN 0 THEN '.srt' WHEN 1 THEN '.VTT' WHEN 2 THEN '.vtt' ELSE '.txt' END"),
        ).alias("path"),
        F.concat(
            F.when(F.col("turn") % 2 == 1, "WEBVTT\n\n").otherwise(""),
            F.lit("1\n00:01:04,250 --> 01:01:06.500\ncue "), F.col("turn").cast("string"),
            F.lit("\n42\nend\n \n2\n00:01.000 --> 00:03.500\n"), body,
            F.lit("\n\n3\n00:00:09,000 --> 00:00:09,000\nno length\n\nno time"),
        ).alias("text"),
    )


BODY = "regexp_replace(text, '\\s*\\n\\s*', chr(10), 'g')"
define("subtitle_files", f"""
SELECT conv_id * 1000 + turn AS video_id,
       'subs/' || (conv_id * 1000 + turn) || CASE turn % 4 WHEN 0 THEN '.srt' WHEN 1 THEN '.VTT' WHEN 2 THEN '.vtt' ELSE '.txt' END AS path,
       CASE WHEN turn % 2 = 1 THEN 'WEBVTT' || chr(10) || chr(10) ELSE '' END
       || E'1\\n00:01:04,250 --> 01:01:06.500\\ncue ' || turn
       || E'\\n42\\nend\\n \\n2\\n00:01.000 --> 00:03.500\\n' || {BODY}
       || E'\\n\\n3\\n00:00:09,000 --> 00:00:09,000\\nno length\\n\\nno time' AS text,
       turn, {BODY} AS body
FROM conversations""")
define("cue_body", f"""
SELECT video_id, turn, path, array_to_string(list_filter(
   list_transform(string_split(body, chr(10)), lambda x: {STRIP.format(x='x')}),
   lambda x: x <> '' AND upper(x) <> 'WEBVTT' AND NOT regexp_full_match(x, '[0-9]+')), ' ') AS body
FROM subtitle_files""")
define("subtitle_cues", """
SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start, "end") - 1 AS seq FROM (
  SELECT video_id, path, 64.25e0 AS start, 3666.5e0 AS "end", 'cue ' || turn || ' end' AS text FROM cue_body
  UNION ALL SELECT video_id, path, 1e0, 3.5e0, body FROM cue_body WHERE body <> '')
WHERE lower(path) LIKE '%.srt' OR lower(path) LIKE '%.vtt'""")


def s2(spark, sf):
    return subtitles.subtitle_segments(subtitle_files(spark, sf))


def s1(spark, sf):
    """One file per conversation, written as text and read back whole."""
    path = scratch_path(spark, "subtitles")
    messages = subtitle_files(spark, sf).select(
        F.floor(F.col("video_id") / 1000).alias("video_id"), (F.col("video_id") % 1000).alias("turn"), "text"
    )
    file_io.write_text_files(documents.stitch(messages, ["video_id"], ["turn"], "text", "\n\n"), path, "srt")
    number = F.regexp_extract("path", r"(\d+)\.srt\z", 1).cast("long")
    files = subtitles.read_subtitle_files(spark, path).select(number.alias("video_id"), "path", "text")
    return subtitles.subtitle_full_text(files).select("video_id", "text")


S1 = query("""
SELECT video_id, string_agg(text, chr(10) ORDER BY start, turn) AS text FROM (
  SELECT video_id // 1000 AS video_id, turn, 64.25e0 AS start, 'cue ' || turn || ' end' AS text FROM cue_body
  UNION ALL SELECT video_id // 1000, turn, 1e0, body FROM cue_body WHERE body <> '')
GROUP BY video_id""")


def a2_files(spark, sf):
    """Every video has a second file, without a cue."""
    files = subtitle_files(spark, sf)
    silent = files.withColumns({"path": F.concat(F.col("path"), F.lit(".srt")), "text": F.lit("WEBVTT\n\nno cue")})
    return subtitles.subtitle_full_text(files.unionByName(silent)).select("video_id", "path", "text")


A2_FILES = query("""
SELECT video_id, path, string_agg(text, chr(10) ORDER BY seq) AS text FROM subtitle_cues GROUP BY video_id, path
UNION ALL SELECT video_id, path, text FROM subtitle_files WHERE path LIKE '%.txt'
UNION ALL SELECT video_id, path || '.srt', '' FROM subtitle_files""")


def f2(spark, sf):
    return subtitle_files(spark, sf).select("video_id", fx.strip_timestamps(F.col("text")).alias("plain"))


F2 = query(f"""
SELECT video_id, array_to_string(list_filter(
   list_transform(string_split(text, chr(10)), lambda x: {STRIP.format(x='x')}),
   lambda x: x <> '' AND NOT starts_with(x, 'WEBVTT') AND NOT regexp_full_match(x, '[0-9]+')
     AND NOT regexp_matches(x, '^\\d{{1,2}}:\\d{{2}}:\\d{{2}}[,\\.]\\d{{3}}\\s*-->')
     AND NOT regexp_matches(x, '^\\d{{1,2}}:\\d{{2}}[,\\.]\\d{{3}}\\s*-->')), chr(10)) AS plain
FROM subtitle_files""")


def moments(spark, sf):
    """Seconds with millisecond precision, some negative, some missing."""
    return t.read(spark, sf, "events").select(
        "event_id",
        F.expr(f"CASE WHEN event_id % 50 = 3 THEN NULL WHEN event_id % 50 = 4 THEN -1.5D ELSE {t.MS} % 360000000 / 1000D END").alias("s"),
        F.expr(f"{t.MS} % 360000000 / 1000D").alias("p"),
        F.expr("CASE WHEN event_id % 2 = 0 THEN 'scene' ELSE 'interval' END").alias("source"),
        F.expr("CAST(event_id % 300 AS INT)").alias("n"),
    )


define("moments", f"""
SELECT event_id, CASE WHEN event_id % 50 = 3 THEN NULL WHEN event_id % 50 = 4 THEN -1.5e0
       ELSE ({t.MS_SQL} % 360000000) / 1000e0 END AS s,
       ({t.MS_SQL} % 360000000) / 1000e0 AS p, ({t.MS_SQL} % 360000000) AS pms,
       CASE WHEN event_id % 2 = 0 THEN 'scene' ELSE 'interval' END AS source, event_id % 300 AS n
FROM events""")


def f3(spark, sf):
    m = moments(spark, sf)
    stamp = F.when(F.col("event_id") % 2 == 0, fx.srt_time(F.col("p"))).otherwise(
        F.concat(F.lit("07:"), F.substr(fx.srt_time(F.col("p")), F.lit(7)))
    )
    return m.select("event_id", fx.parse_time(stamp).alias("seconds"))


F3 = query("""
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(pms // 60000 * 60 AS DOUBLE) ELSE 420e0 END
                 + (pms % 60000) / 1000e0 AS seconds FROM moments""")


def f4(spark, sf):
    return moments(spark, sf).select(
        "event_id", fx.srt_time(F.col("s")).alias("clamped"), fx.srt_time(F.col("s"), clamp=False).alias("plain")
    )


F4 = query(f"""
SELECT event_id, CASE WHEN s IS NOT NULL THEN {srt_sql('greatest(s, 0)')} END AS clamped,
       CASE WHEN s < 0 THEN '-1:59:58,500' ELSE {srt_sql('s')} END AS plain
FROM moments""")


def f5(spark, sf):
    return moments(spark, sf).select("event_id", fx.hms(F.col("s")).alias("label"))


F5 = query("""
SELECT event_id, printf('%02d:%02d:%02d', x // 3600, x // 60 % 60, x % 60) AS label
FROM (SELECT event_id, CAST(floor(greatest(coalesce(s, 0), 0)) AS BIGINT) AS x FROM moments)""")


def f6(spark, sf):
    return moments(spark, sf).select("event_id", fx.capture_label(F.col("p")).alias("label"))


F6 = query("""
SELECT event_id, printf('%02d:%02d:%02d.%03d', pms // 3600000, pms // 60000 % 60, pms // 1000 % 60, pms % 1000) AS label
FROM moments""")


def f8(spark, sf):
    return moments(spark, sf).select("event_id", fx.frame_name(F.col("p"), F.col("source"), F.col("n")).alias("name"))


F8 = query("""
SELECT event_id, printf('frame_%02dh%02dm%02ds%03dms_', pms // 3600000, pms // 60000 % 60, pms // 1000 % 60,
       pms % 1000) || source || printf('_%03d.jpg', n) AS name FROM moments""")


def listing(spark, sf):
    """A file listing: names with and without milliseconds, and without a time."""
    name = F.expr("CASE event_id % 4 WHEN 0 THEN 'frame_00h04m12s.jpg' WHEN 1 THEN 'a1_12.5.jpg' END")
    return moments(spark, sf).select(
        F.concat(F.lit("src/"), F.coalesce(name, fx.frame_name(F.col("p"), F.col("source"), F.col("n")))).alias("path"),
        F.col("event_id").alias("size"),
    )


def f7(spark, sf):
    return listing(spark, sf).select(F.col("size").alias("event_id"), fx.frame_name_time(F.col("path")).alias("seconds"))


F7 = query("""
SELECT event_id, CASE WHEN event_id % 4 < 2 THEN 0e0
       ELSE CAST(pms // 1000 AS DOUBLE) + (pms % 1000) / 1000e0 END AS seconds FROM moments""")


def s8(spark, sf):
    return file_io.frames_from_listing(listing(spark, sf)).select("path", "size", "timestamp_sec", "source")


S8 = query("""
SELECT 'src/' || CASE event_id % 4 WHEN 0 THEN 'frame_00h04m12s.jpg' WHEN 1 THEN 'a1_12.5.jpg'
       ELSE printf('frame_%02dh%02dm%02ds%03dms_', pms // 3600000, pms // 60000 % 60, pms // 1000 % 60, pms % 1000)
            || source || printf('_%03d.jpg', n) END AS path,
       event_id AS size,
       CASE WHEN event_id % 4 < 2 THEN 0e0 ELSE CAST(pms // 1000 AS DOUBLE) + (pms % 1000) / 1000e0 END AS timestamp_sec,
       'heuristic' AS source
FROM moments""")


def f32(spark, sf):
    s = t.segments(spark, sf)
    start, end = F.col("start"), F.when(F.col("seq") % 31 == 2, 0.0).otherwise(F.col("end"))
    return s.select(
        "video_id", "seq", fx.display_start(start).alias("shown_start"), fx.display_end(start, end).alias("shown_end"),
        F.coalesce(F.when(F.col("seq") % 7 > 0, F.col("text")), F.lit("")).alias("shown_text"),
    )


F32 = query("""
SELECT video_id, seq, coalesce(start, 0) AS shown_start,
       coalesce(nullif(CASE WHEN seq % 31 = 2 THEN 0 ELSE "end" END, 0), start, 0) AS shown_end,
       CASE WHEN seq % 7 > 0 THEN text ELSE '' END AS shown_text FROM segs""")


def results(spark, sf):
    """Recognition results: one audio piece per message, sentences from its lines."""
    # A second transcript that must not be read, a blank sentence, a missing time.
    sentence = F.struct(
        F.col("text").alias("text"), (F.col("turn") * 100).alias("begin_time"),
        F.when(F.col("turn") % 5 > 0, F.col("turn") * 100 + 2500).alias("end_time"),
    )
    blank = F.struct(F.lit("  ").alias("text"), F.lit(0).cast("long").alias("begin_time"), F.lit(1).cast("long").alias("end_time"))
    doc = F.struct(
        F.array(
            F.struct(F.array(blank, sentence, sentence).alias("sentences")),
            F.struct(F.array(sentence).alias("sentences")),
        ).alias("transcripts")
    )
    return t.read(spark, sf, "conversations").select(
        F.col("conv_id").alias("video_id"),
        F.col("turn").cast("int").alias("index"),
        (F.col("turn") * 300.0).alias("start_sec"),
        F.when(F.col("turn") % 7 == 6, '{"transcripts": []}').otherwise(F.to_json(doc)).alias("result"),
    )


define("sentences", f"""
SELECT conv_id AS video_id, CAST(turn AS INTEGER) AS index, position, {STRIP.format(x='text')} AS text,
       turn * 100 / 1000e0 + turn * 300e0 AS start,
       CASE WHEN turn % 5 > 0 THEN turn * 100 + 2500 ELSE 0 END / 1000e0 + turn * 300e0 AS "end"
FROM conversations CROSS JOIN (SELECT 1 AS position UNION ALL SELECT 2)
WHERE turn % 7 <> 6 AND {STRIP.format(x='text')} <> ''""")


def s3(spark, sf):
    return subtitles.recognised_segments(results(spark, sf)).select("video_id", "index", "position", "text")


def j12(spark, sf):
    pieces = results(spark, sf).select("video_id", "index", "start_sec")
    raw = results(spark, sf).select("video_id", "index", "result")
    return subtitles.recognised_segments(raw.join(pieces, ["video_id", "index"])).select(
        "video_id", "index", "position", "start", "end"
    )


def merged(spark, sf):
    """Recognised segments in piece order, numbered per video."""
    return ordered(
        subtitles.recognised_segments(results(spark, sf)), ["video_id"], ["index", "position"], {"seq": ordinal()}
    ).select("video_id", "seq", "text", "start", F.when(F.col("seq") % 6 > 0, F.col("end")).alias("end"))


define("merged", """
SELECT video_id, seq, text, start, CASE WHEN seq % 6 > 0 THEN "end" END AS "end" FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY index, position) AS seq FROM sentences)""")


def a1(spark, sf):
    return documents.srt_from_results(merged(spark, sf)).select("video_id", "part", "text")


A1 = query(f"""
SELECT video_id, 0 AS part, string_agg(seq || chr(10) || {srt_sql('start')} || ' --> ' || {srt_sql('"end"')}
       || chr(10) || text, chr(10) || chr(10) ORDER BY seq) AS text
FROM merged WHERE "end" IS NOT NULL GROUP BY video_id""")


def s10(spark, sf):
    """Subtitle rows written as SRT files and read back."""
    path = scratch_path(spark, "srt")
    rows = merged(spark, sf).withColumn("end", F.coalesce("end", "start"))
    file_io.write_text_files(documents.srt_from_rows(rows), path, "srt")
    return file_io.read_text_files(spark, path, "srt").select(
        F.col("video_id").cast("long").alias("video_id"), F.lit(0).alias("part"), "text"
    )


S10 = query(f"""
SELECT video_id, 0 AS part, string_agg(seq || chr(10) || {srt_sql('start')} || ' --> '
       || {srt_sql('coalesce("end", start)')} || chr(10) || text || chr(10), chr(10) ORDER BY seq) AS text
FROM merged GROUP BY video_id""")


def a2(spark, sf):
    return documents.full_text(merged(spark, sf), " ").select("video_id", "part", "text")


A2 = query("SELECT video_id, 0 AS part, string_agg(text, ' ' ORDER BY seq) AS text FROM merged GROUP BY video_id")


def payloads(spark, sf, build):
    """One JSON payload per conversation message."""
    return t.read(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("video_id"), build.alias("body")
    )


def s4(spark, sf):
    n = F.col("turn")
    item = F.struct(
        F.concat(F.lit(">> "), F.col("text"), F.lit(" >>")).alias("text"),
        (n * 1500).alias("offset"), F.when(n % 3 > 0, n * 50).alias("duration"),
    )
    empty = F.struct(F.lit(" >> ").alias("text"), F.lit(1).cast("long").alias("offset"), F.lit(1).cast("long").alias("duration"))
    return subtitles.timed_transcript(payloads(spark, sf, F.to_json(F.struct(F.array(empty, item).alias("content")))))


S4 = query(f"""
SELECT conv_id * 1000 + turn AS video_id, 1 AS position, {STRIP.format(x="replace('>> ' || text || ' >>', '>>', '')")} AS text,
       turn * 1500 / 1000e0 AS start,
       turn * 1500 / 1000e0 + greatest(CASE WHEN turn % 3 > 0 THEN turn * 50 ELSE 0 END / 1000e0, 0.2e0) AS "end"
FROM conversations WHERE {STRIP.format(x='text')} <> ''""")


def track_payloads(spark, sf):
    n = F.col("turn")
    link = F.concat(F.lit("//sub.example.com/"), F.col("conv_id").cast("string"))

    def track(lan, doc, url, other):
        as_text = [F.lit(x).cast("string") if not hasattr(x, "alias") else x for x in (lan, doc, url, other)]
        return F.struct(*[c.alias(n) for c, n in zip(as_text, ["lan", "lan_doc", "subtitle_url", "url"])])

    tracks = F.array(
        track("xx", "gone", "", None),
        track(F.expr("CASE turn % 3 WHEN 0 THEN 'en' WHEN 1 THEN ' ' ELSE 'fr' END"), None, link, None),
        track(None, F.when(n % 2 == 0, "中文（自动）"), None, F.lit("https://sub.example.com/b")),
        track("", " ", "http://sub.example.com/c", None),
    )
    doc = F.struct(F.struct(F.struct(tracks.alias("subtitles")).alias("subtitle")).alias("data"))
    return payloads(spark, sf, F.to_json(doc))


define("tracks", """
SELECT video_id, CAST(position AS INTEGER) AS position, coalesce(lan, doc, 'subtitle-' || position) AS id,
       coalesce(doc, lan, '字幕 ' || position) AS label, coalesce(lan, '') AS lan, url FROM (
  SELECT conv_id * 1000 + turn AS video_id, 1 AS position,
         CASE turn % 3 WHEN 0 THEN 'en' WHEN 2 THEN 'fr' END AS lan, CAST(NULL AS VARCHAR) AS doc,
         'https://sub.example.com/' || conv_id AS url FROM conversations
  UNION ALL SELECT conv_id * 1000 + turn, 2, NULL, CASE WHEN turn % 2 = 0 THEN '中文（自动）' END,
         'https://sub.example.com/b' FROM conversations
  UNION ALL SELECT conv_id * 1000 + turn, 3, NULL, NULL, 'http://sub.example.com/c' FROM conversations)""")


def s5(spark, sf):
    return subtitles.subtitle_tracks(track_payloads(spark, sf))


def body_payloads(spark, sf):
    n = F.col("turn")
    one = F.struct(
        F.concat(F.col("text"), F.lit(" ")).alias("content"), (n * 2.5).alias("from"),
        F.expr("CASE turn % 3 WHEN 0 THEN turn * 2.5D + 1.25D WHEN 1 THEN 0D END").alias("to"),
    )
    blank = F.struct(F.lit(" ").alias("content"), F.lit(1.0).alias("from"), F.lit(2.0).alias("to"))
    rows = F.array(blank, one)
    doc = (
        F.when(n % 4 == 0, F.to_json(F.struct(rows.alias("body"))))
        .when(n % 4 == 1, F.to_json(F.struct(F.lit("x").alias("body"), F.struct(rows.alias("body")).alias("data"))))
        .when(n % 4 == 2, F.to_json(F.struct(F.struct(rows.alias("body")).alias("result"))))
        .otherwise(F.to_json(F.struct(rows.alias("content"))))
    )
    return payloads(spark, sf, doc)


def s6(spark, sf):
    return body_payloads(spark, sf).select(
        "video_id", F.inline(subtitles.subtitle_body(F.col("body")))
    ).select("video_id", "content", F.col("from").alias("starts"), F.col("to").alias("ends"))


S6 = """
SELECT conv_id * 1000 + turn AS video_id, text || ' ' AS content, turn * 2.5e0 AS starts,
       CASE turn % 3 WHEN 0 THEN turn * 2.5e0 + 1.25e0 WHEN 1 THEN 0e0 END AS ends FROM conversations
UNION ALL SELECT conv_id * 1000 + turn, ' ', 1e0, 2e0 FROM conversations"""


def s7(spark, sf):
    return subtitles.body_segments(body_payloads(spark, sf))


S7 = f"""
SELECT conv_id * 1000 + turn AS video_id, 1 AS position, {STRIP.format(x='text')} AS text, turn * 2.5e0 AS start,
       CASE WHEN turn % 3 = 0 THEN turn * 2.5e0 + 1.25e0 ELSE turn * 2.5e0 + 3e0 END AS "end"
FROM conversations WHERE {STRIP.format(x='text')} <> ''"""


def untimed(spark, sf):
    return t.read_texts(spark, sf).select(
        F.col("doc_id").alias("video_id"), "text",
        F.expr("CASE WHEN doc_id % 5 = 0 THEN 0D ELSE CAST(n_chars AS DOUBLE) / 8 END").alias("duration_sec"),
    )


# Running sums may differ in the last bit between engines; the shift keeps times
# that are exactly half a microsecond from rounding apart.
NUDGE = "0.000000123e0"


def w4(spark, sf):
    shift = F.expr(NUDGE)
    return chunking.synthesize_segments(untimed(spark, sf)).select(
        "video_id", "seq", "text", F.round(F.col("start") + shift, 6).alias("start"), F.round(F.col("end") + shift, 6).alias("end")
    )


define("synthetic", f"""
SELECT *, d * w / sum(w) OVER (PARTITION BY video_id) AS step FROM (
  SELECT video_id, i - 1 AS seq, l[i] AS text, CAST(length(l[i]) AS DOUBLE) AS w,
         CASE WHEN duration_sec > 0 THEN duration_sec ELSE greatest(4.5e0, 4.5e0 * len(l)) END AS d
  FROM (SELECT doc_id AS video_id, CASE WHEN doc_id % 5 = 0 THEN 0e0 ELSE n_chars / 8e0 END AS duration_sec,
               list_filter(list_transform(string_split(text, chr(10)), lambda x: {STRIP.format(x='x')}),
                           lambda x: x <> '') AS l FROM documents),
       unnest(range(1, len(l) + 1)) AS u(i))""")
define("synthetic_starts", """
SELECT *, coalesce(sum(step) OVER (PARTITION BY video_id ORDER BY seq
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS start FROM synthetic""")
W4 = query(f"""
SELECT video_id, seq, text, round(start + {NUDGE}, 6) AS start,
       round(greatest(start + 0.1e0, coalesce(lead(start) OVER (PARTITION BY video_id ORDER BY seq), d)) + {NUDGE}, 6) AS "end"
FROM synthetic_starts""")


def media(spark, sf):
    return t.read_texts(spark, sf).select(
        F.col("doc_id").alias("video_id"), F.expr("CAST(n_chars AS DOUBLE) / 8").alias("duration_sec")
    )


def g1(spark, sf):
    return chunking.split_plan(media(spark, sf), 300.0)


G1 = """
SELECT doc_id AS video_id, CAST(i AS INTEGER) AS index, i * 300e0 AS start_sec,
       least(300e0, n_chars / 8e0 - i * 300e0) AS piece_sec
FROM documents, unnest(range(0, CAST(ceil(n_chars / 2400e0) AS BIGINT))) AS u(i)"""


def g2(spark, sf):
    return chunking.interval_grid(media(spark, sf), 30.0)


G2 = """
SELECT doc_id AS video_id, i * 30e0 AS timestamp_sec
FROM documents, unnest(range(0, CAST(ceil(n_chars / 240e0) AS BIGINT))) AS u(i)"""


def f28(spark, sf):
    """Message texts as image bytes."""
    files = t.read(spark, sf, "conversations").select(
        F.concat(
            F.lit("src/"), (F.col("conv_id") * 1000 + F.col("turn")).cast("string"),
            F.expr("CASE turn % 5 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG' WHEN 2 THEN '.webp' WHEN 3 THEN '.bmp' ELSE '' END"),
        ).alias("path"),
        F.encode("text", "UTF-8").alias("content"),
    )
    return file_io.encode_images(files)


F28 = """
SELECT 'src/' || (conv_id * 1000 + turn)
       || CASE turn % 5 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG' WHEN 2 THEN '.webp' WHEN 3 THEN '.bmp' ELSE '' END AS path,
       base64(encode(text)) AS data,
       CASE turn % 5 WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/webp' ELSE 'image/jpeg' END AS mime
FROM conversations"""


def a4(spark, sf):
    return reuse.frames_digest(t.frames(spark, sf))


A4 = query("""
SELECT video_id, substr(sha256(string_agg(path || '|' || printf('%.6f', timestamp_sec) || chr(10), ''
       ORDER BY timestamp_sec, frame_id)), 1, 16) AS digest
FROM frames GROUP BY video_id""")

QUERIES = {
    "f1_clean_transcript": (f1, F1),
    "w5_collapse_repeats": (w5, W5),
    "s1_subtitle_files": (s1, S1),
    "s2_subtitle_cues": (s2, query('SELECT video_id, seq, text, start, "end" FROM subtitle_cues')),
    "a2_file_text": (a2_files, A2_FILES),
    "f2_strip_timestamps": (f2, F2),
    "f3_parse_time": (f3, F3),
    "f4_srt_time": (f4, F4),
    "f5_hms": (f5, F5),
    "f6_capture_label": (f6, F6),
    "f7_frame_name_time": (f7, F7),
    "f8_frame_name": (f8, F8),
    "s8_frame_listing": (s8, S8),
    "f32_display_defaults": (f32, F32),
    "s3_recognition_results": (s3, query("SELECT video_id, index, position, text FROM sentences")),
    "j12_piece_offsets": (j12, query('SELECT video_id, index, position, start, "end" FROM sentences')),
    "a1_srt_text": (a1, A1),
    "s10_srt_sink": (s10, S10),
    "a2_full_text": (a2, A2),
    "s4_timed_transcript": (s4, S4),
    "s5_subtitle_tracks": (s5, query("SELECT * FROM tracks")),
    "s6_subtitle_body": (s6, S6),
    "s7_body_segments": (s7, S7),
    "w4_synthetic_segments": (w4, W4),
    "g1_split_plan": (g1, G1),
    "g2_interval_grid": (g2, G2),
    "f28_encode_images": (f28, F28),
    "a4_frames_digest": (a4, A4),
}
