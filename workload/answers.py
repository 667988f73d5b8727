"""Model answers: extraction, checks, repair, retries, retakes, documents, duplicates."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import model_output as mo
from lectern.operators import anchors, dedup, documents, inference, runs
from lectern.plans.lecture import Prepared, assemble
from lectern.session import scratch_path
from lectern.sources import files as file_io
from workload import tables as t
from workload.sqlparts import define, query
from workload.timeline import _ready

KEYS = ["video_id", "chunk_index"]

# --- anchors in document texts ---------------------------------------------------

MARKED = "text || chr(10) || '[[FRAME:a' || (doc_id % 3) || '@' || doc_id || '.25]] x [[FRAME:bad id@1]] [[FRAME:b_1@' || n_chars || ']]'"


def marked(spark, sf):
    return t.read_texts(spark, sf).select("doc_id", F.expr(MARKED).alias("markdown"))


def f19(spark, sf):
    return marked(spark, sf).select("doc_id", F.posexplode(mo.anchors(F.col("markdown"))).alias("pos", "a")).select(
        "doc_id", "pos", "a.anchor_id", "a.timestamp"
    )


F19 = """
SELECT doc_id, 0 AS pos, 'a' || (doc_id % 3) AS anchor_id, doc_id + 0.25e0 AS timestamp FROM documents
UNION ALL SELECT doc_id, 1, 'b_1', CAST(n_chars AS DOUBLE) FROM documents"""


def f20(spark, sf):
    chunk = F.col("doc_id").cast("string")
    return marked(spark, sf).select(
        "doc_id", mo.global_anchor_text(F.col("markdown"), chunk).alias("markdown"),
        F.transform(mo.anchors(F.col("markdown")), lambda a: mo.global_anchor_id(a["anchor_id"], chunk))[0].alias("first_id"),
    )


F20 = """
SELECT doc_id, text || chr(10) || '[[FRAME:c' || doc_id || '_a' || (doc_id % 3) || '@' || doc_id || '.25]] x [[FRAME:bad id@1]] [[FRAME:c'
       || doc_id || '_b_1@' || n_chars || ']]' AS markdown, 'c' || doc_id || '_a' || (doc_id % 3) AS first_id FROM documents"""

# --- JSON in model text ------------------------------------------------------------


def wrapped(spark, sf):
    docs = t.read_texts(spark, sf).withColumn(
        "j", F.to_json(F.struct(F.col("text").alias("blog_markdown"), F.col("doc_id").alias("n")))
    )
    raw = F.expr("""CASE doc_id % 8
      WHEN 0 THEN j WHEN 1 THEN 'Sure:' || chr(10) || '```json' || chr(10) || j || chr(10) || '``` and {more}'
      WHEN 2 THEN j || ' {"blog_markdown": "second"}' WHEN 3 THEN substr(j, 1, length(j) - 1)
      WHEN 4 THEN '{"a": 1, "a": 2, ' || substr(j, 2) WHEN 5 THEN 'no object'
      WHEN 6 THEN '{"v": NaN, ' || substr(j, 2) ELSE '[' || j || ']' END""")
    return docs.select("doc_id", raw.alias("raw"))


def f22(spark, sf):
    obj = F.col("obj")
    return mo.json_objects(wrapped(spark, sf), "raw").select(
        "doc_id", mo.string_field(obj, "blog_markdown").alias("blog"), F.try_variant_get(obj, "$.n", "long").alias("n")
    )


F22 = """
SELECT doc_id, CASE WHEN doc_id % 8 NOT IN (3, 5) THEN text END AS blog,
       CASE WHEN doc_id % 8 NOT IN (3, 5) THEN doc_id END AS n FROM documents"""

BOOLS = [
    ("true", True), ("false", False), ('"TRUE"', True), ('" false "', False), ("1", None), ('"yes"', None),
    ("null", None), ("[true]", None),
]
REQUESTS = [
    ({"anchor_id": "a1", "srt_id": 3, "timestamp": 53.0, "request_type": "reuse", "source_frame_path": "p", "reason": "r"},
     ("a1", 3, 53.0, "reuse", "p", "r")),
    ({"anchor_id": "a2", "srt_id": "4", "timestamp": "633.5", "request_type": "new_capture", "source_frame_path": None},
     ("a2", 4, 633.5, "new_capture", None, "")),
    ({"anchor_id": "a3", "srt_id": 2.9, "timestamp": 0, "request_type": "new_capture", "reason": 7},
     ("a3", 2, 0.0, "new_capture", None, "7")),
    ({"anchor_id": "", "srt_id": 1, "timestamp": 1, "request_type": "new_capture"}, None),
    ({"anchor_id": 5, "srt_id": 1, "timestamp": 1, "request_type": "new_capture"}, None),
    ({"anchor_id": "a", "srt_id": 0, "timestamp": 1, "request_type": "new_capture"}, None),
    ({"anchor_id": "a", "srt_id": "2.5", "timestamp": 1, "request_type": "new_capture"}, None),
    ({"anchor_id": "a", "srt_id": 1, "timestamp": -1, "request_type": "new_capture"}, None),
    ({"anchor_id": "a", "srt_id": 1, "timestamp": "nan", "request_type": "new_capture"}, None),
    ({"anchor_id": "a", "srt_id": 1, "request_type": "new_capture"}, None),
    ({"anchor_id": "a", "srt_id": 1, "timestamp": 1, "request_type": "other"}, None),
    ({"anchor_id": "a", "srt_id": 1, "timestamp": 1, "request_type": "reuse"}, None),
    ({"anchor_id": "a", "srt_id": 1, "timestamp": 1, "request_type": "reuse", "source_frame_path": ""}, None),
    ({"anchor_id": "a", "srt_id": 1, "timestamp": 1, "request_type": "new_capture", "source_frame_path": "p"}, None),
    ([1], None),
]
DECISIONS = [
    ({"keep_image": True, "content_type": "code", "caption": "c", "text_representation": "t", "reason": "r"},
     ("asked.jpg", True, "code", "c", "t", "r", False, None)),
    ({"keep_image": "false", "content_type": "poem", "frame": "other.jpg"},
     ("other.jpg", False, "other", "", "", "", False, None)),
    ({"retake": "true", "retake_timestamp": "12.5", "keep_image": True},
     ("asked.jpg", True, "other", "", "", "", True, 12.5)),
    ({"retake": False, "retake_timestamp": "x"}, ("asked.jpg", False, "other", "", "", "", False, None)),
    ({"retake": True}, None),
    ({"retake": True, "retake_timestamp": -2}, None),
    ({"keep_image": 1}, None),
    ({"keep_image": True, "retake": "no"}, None),
    ("text", None),
]


def _pick(rows: list, position: str) -> Column:
    """The ``position``-th of a fixed list of JSON texts."""
    return F.get(F.array(*[F.lit(r) for r in rows]), F.expr(position))


def _sql_value(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return f"'{value}'"
    return f"{value!r}e0" if isinstance(value, float) else str(value)


def _expected(cases: list, position: str, names: list[str], key: str, table: str) -> str:
    cols = []
    for i, name in enumerate(names):
        whens = " ".join(f"WHEN {k} THEN {_sql_value(e[i])}" for k, (_, e) in enumerate(cases) if e is not None)
        cols.append(f"CASE {position} {whens} END AS {name}")
    return f"SELECT {key}, {', '.join(cols)} FROM {table}"


def f23(spark, sf):
    value = _pick([f'{{"b": {x}}}' for x, _ in BOOLS], f"CAST(event_id % {len(BOOLS)} AS INT)")
    return t.read_spread(spark, sf, "events").select(
        "event_id", mo.strict_bool(F.try_parse_json(value), "b").alias("flag")
    )


def f24(spark, sf):
    raw = _pick([json.dumps(r) for r, _ in REQUESTS], f"CAST(event_id % {len(REQUESTS)} AS INT)")
    return (
        t.read_spread(spark, sf, "events")
        .select("event_id", mo.frame_request(F.try_parse_json(raw)).alias("r"))
        .select("event_id", "r.*")
    )


def f25(spark, sf):
    raw = _pick([json.dumps(r) for r, _ in DECISIONS], f"CAST(event_id % {len(DECISIONS)} AS INT)")
    return (
        t.read_spread(spark, sf, "events")
        .select("event_id", mo.frame_decision(F.try_parse_json(raw), F.lit("asked.jpg")).alias("d"))
        .select("event_id", "d.*")
    )


# --- answers per chunk ----------------------------------------------------------------

CASE_OF = "(video_id * 31 + chunk_index) % 12"


def chunk_answers(ready: Prepared) -> DataFrame:
    """One text-model answer per chunk, twelve kinds of right and wrong."""
    paths = ready.frames.groupBy(*KEYS).agg(F.min("path").alias("fp"))
    rows = (
        ready.chunks.join(paths, KEYS, "left")
        .withColumn("k", F.expr(CASE_OF))
        .withColumn("s", F.floor("start_sec"))
    )
    markers = F.expr("""CASE WHEN k = 11 THEN 'plain' ELSE
      'Intro [[FRAME:a1@' || s || '.5]] more\\\\n\\\\n\\\\n\\\\n[[FRAME:a2@' || (s + 60) || '.5]] end'
      || CASE WHEN k = 6 THEN ' again [[FRAME:a1@9.0]]' ELSE '' END END""")
    first = F.expr("""'{"anchor_id":"a1","srt_id":' || CASE k WHEN 4 THEN '999' WHEN 7 THEN '"1"' ELSE '1' END
      || ',"timestamp":' || CASE k WHEN 1 THEN (s + 1) || '.0' ELSE s || '.5' END
      || ',"request_type":"reuse","source_frame_path":"'
      || CASE k WHEN 5 THEN 'src/unknown.jpg' ELSE coalesce(fp, 'src/none.jpg') END || '","reason":"first"}'""")
    second = F.expr("""'{"anchor_id":"a2","srt_id":1,"timestamp":' || (s + 60)
      || '.5,"request_type":"new_capture","source_frame_path":null,"reason":""}'""")
    third = F.lit('{"anchor_id":"a3","srt_id":1,"timestamp":5,"request_type":"new_capture"}')
    k = F.col("k")
    listed = F.concat_ws(
        ",", F.when(k != 11, first), F.when(k == 6, first), F.when(~k.isin(2, 11), second), F.when(k == 3, third)
    )
    body = F.concat(
        F.lit('{"blog_markdown":"## Part\\n\\n'.replace("\n", "\\n")), markers,
        F.lit('","frame_requests":['), listed, F.lit("]}"),
    )
    rows = rows.withColumn("body", body)
    raw = F.expr("""CASE k WHEN 8 THEN 'Sure:' || chr(10) || '```json' || chr(10) || body || chr(10) || '``` Done {x}'
      WHEN 9 THEN substr(body, 1, length(body) - 1) WHEN 10 THEN body || chr(10) || '{"other": 1}' ELSE body END""")
    return rows.select(*KEYS, raw.alias("response"))


define("kinds", f"""
SELECT c.*, ({CASE_OF.replace('video_id', 'c.video_id').replace('chunk_index', 'c.chunk_index')}) AS k, p.fp,
       CAST(floor(c.start_sec) AS BIGINT) AS s
FROM chunks c LEFT JOIN (SELECT video_id, chunk_index, min(path) AS fp FROM capped GROUP BY video_id, chunk_index) p
ON c.video_id = p.video_id AND c.chunk_index = p.chunk_index""")


def j9(spark, sf):
    ready = _ready(spark, sf)
    return anchors.strict_answers(anchors.read_answers(chunk_answers(ready)), ready.chunks, ready.frames).select(
        *KEYS, "valid", F.size("frame_requests").alias("n_requests")
    )


VALID = "(k = 11 OR (k IN (0, 7, 8, 10) AND fp IS NOT NULL))"
J9 = query(f"""
SELECT video_id, chunk_index, {VALID} AS valid, CASE WHEN {VALID} THEN CASE WHEN k = 11 THEN 0 ELSE 2 END END AS n_requests
FROM kinds""")


def _repaired(spark, sf):
    ready = _ready(spark, sf)
    return anchors.repaired_requests(
        anchors.read_answers(chunk_answers(ready)), ready.segments, ready.chunks, ready.frames, large=ready.large
    )


def j10(spark, sf):
    return _repaired(spark, sf).drop("pos")


define("wanted", """
SELECT *, 'a1' AS anchor_id, s + 0.5e0 AS t, k <> 4 AS ok FROM kinds WHERE k NOT IN (9, 11)
UNION ALL SELECT *, 'a2', s + 60.5e0, k <> 2 FROM kinds WHERE k NOT IN (9, 11)""")
define("wanted_near", """
SELECT w.video_id, w.chunk_index, w.anchor_id, m.srt_id AS near FROM wanted w
JOIN members m ON w.video_id = m.video_id AND w.chunk_index = m.chunk_index
QUALIFY row_number() OVER (PARTITION BY w.video_id, w.chunk_index, w.anchor_id
  ORDER BY abs((m.start + coalesce(m."end", 0)) / 2e0 - w.t), m.srt_id) = 1""")
J10 = query(f"""
SELECT w.video_id, w.chunk_index, w.anchor_id, CAST(CASE WHEN ok THEN 1 ELSE near END AS INTEGER) AS srt_id, t AS timestamp,
       CASE WHEN w.anchor_id = 'a1' AND fp IS NOT NULL AND k <> 5 THEN 'reuse' ELSE 'new_capture' END AS request_type,
       CASE WHEN w.anchor_id = 'a1' AND fp IS NOT NULL AND k <> 5 THEN fp END AS source_frame_path,
       CASE WHEN w.anchor_id = 'a2' THEN '{anchors.COMPLETED_REASON}'
            WHEN fp IS NOT NULL AND k <> 5 THEN 'first'
            ELSE '{anchors.RECAPTURE_REASON[0]}' || s || '.5{anchors.RECAPTURE_REASON[1]}' END AS reason
FROM wanted w JOIN wanted_near n ON w.video_id = n.video_id AND w.chunk_index = n.chunk_index AND w.anchor_id = n.anchor_id""")


def u4(spark, sf):
    """Marker ids without a request and request ids without a marker, per chunk."""
    read = anchors.read_answers(chunk_answers(_ready(spark, sf)))
    asked = F.array_distinct(
        F.transform(F.filter("requests", lambda r: r.isNotNull()), lambda r: r["anchor_id"])
    )
    shown = F.array_distinct(F.transform("markers", lambda m: m["anchor_id"]))
    return read.where("requests IS NOT NULL").select(
        *KEYS, F.array_join(F.array_except(shown, asked), ",").alias("only_marked"),
        F.array_join(F.array_except(asked, shown), ",").alias("only_asked"),
    )


U4 = query("""
SELECT video_id, chunk_index, CASE WHEN k = 2 THEN 'a2' ELSE '' END AS only_marked,
       CASE WHEN k = 3 THEN 'a3' ELSE '' END AS only_asked FROM kinds WHERE k <> 9""")


def w7(spark, sf):
    """First marker of each id per chunk."""
    read = anchors.read_answers(chunk_answers(_ready(spark, sf))).select(
        *KEYS, F.posexplode("markers").alias("pos", "m")
    ).select(*KEYS, "pos", "m.*")
    return anchors.first_by_position(read, [*KEYS, "anchor_id"], "pos").drop("pos")


W7 = query("SELECT video_id, chunk_index, anchor_id, t AS timestamp FROM wanted")

# --- decisions per batch -----------------------------------------------------------------


def batch_items(spark, sf):
    """Frames of a video in batches of eight, with global anchor ids."""
    return t.read(spark, sf, "labels").select(
        (F.col("doc_id") % 50).alias("video_id"), F.floor(F.col("doc_id") / 400).cast("int").alias("batch"),
        F.expr("'c' || (doc_id % 50) || '_a' || doc_id").alias("anchor_id"), F.expr("CAST(doc_id % 7 AS INT)").alias("srt_id"),
        F.expr("'f/' || doc_id || '.jpg'").alias("frame_path"), F.expr("CAST(doc_id AS DOUBLE)").alias("timestamp"),
        "doc_id", "quality", "toxic",
    )


define("batch_items", """
SELECT doc_id % 50 AS video_id, CAST(doc_id // 400 AS INTEGER) AS batch, 'c' || (doc_id % 50) || '_a' || doc_id AS anchor_id,
       doc_id, quality, toxic, doc_id % 11 AS kind FROM labels""")


def batch_answers(spark, sf):
    """One answer per batch. By item: full id, short id, left out, invalid, repeated, unknown."""
    one = F.expr("""CASE doc_id % 11 WHEN 1 THEN 'a' || doc_id ELSE anchor_id END""")
    text = F.concat(
        F.lit('{"anchor_id":"'), one, F.lit('","keep_image":'),
        F.expr("CASE WHEN doc_id % 11 = 3 THEN '\"maybe\"' WHEN quality = 1 THEN 'true' ELSE '\"false\"' END"),
        F.lit(',"caption":"n'), F.col("doc_id").cast("string"), F.lit('"}'),
    )
    listed = F.when(F.col("doc_id") % 11 != 2, F.concat(
        text, F.when(F.col("doc_id") % 11 == 4, F.concat(F.lit(","), F.regexp_replace(text, '"n', '"again'))).otherwise(""),
        F.when(F.col("doc_id") % 11 == 5, ',{"anchor_id":"zz","keep_image":true},7').otherwise(""),
    ))
    rows = batch_items(spark, sf).select("video_id", "batch", F.col("doc_id"), listed.alias("piece")).where("piece IS NOT NULL")
    joined = documents.stitch(rows, ["video_id", "batch"], ["doc_id"], "piece", ",")
    return joined.select(
        "video_id", "batch", F.concat(F.lit('{"decisions":['), F.col("text"), F.lit("]}")).alias("response")
    )


def j11(spark, sf):
    asked = batch_items(spark, sf)
    found = anchors.match_decisions(anchors.read_decisions(batch_answers(spark, sf)), asked)
    return found.select("video_id", "batch", F.coalesce("anchor_id", F.lit("-")).alias("said"), "item_id")


J11 = query("""
SELECT video_id, batch, CASE WHEN kind = 1 THEN 'a' || doc_id ELSE anchor_id END AS said, anchor_id AS item_id
FROM batch_items WHERE kind <> 2
UNION ALL SELECT video_id, batch, anchor_id, anchor_id FROM batch_items WHERE kind = 4
UNION ALL SELECT video_id, batch, x, NULL FROM batch_items, (SELECT unnest(['zz', '-']) AS x) WHERE kind = 5""")


def j15(spark, sf):
    _, _, verdicts = anchors.evaluate_batches(batch_answers(spark, sf), batch_items(spark, sf))
    return verdicts.select("video_id", "batch", "n_items", "n_decisions", "n_recovered", "verdict")


J15 = query("""
SELECT video_id, batch, n_items, n_decisions, n_recovered,
  CASE WHEN n_decisions = n_items AND n_recovered = n_items THEN 'strict' WHEN n_recovered = n_items THEN 'repaired'
       WHEN n_recovered > 0 THEN 'partial' ELSE 'rejected' END AS verdict
FROM (SELECT video_id, batch, count(*) AS n_items,
             CAST(sum(CASE kind WHEN 2 THEN 0 WHEN 4 THEN 2 WHEN 5 THEN 3 ELSE 1 END) AS BIGINT) AS n_decisions,
             count(*) FILTER (WHERE kind NOT IN (2, 3)) AS n_recovered FROM batch_items GROUP BY video_id, batch)""")


def j15_missing(spark, sf):
    _, missing, _ = anchors.evaluate_batches(batch_answers(spark, sf), batch_items(spark, sf))
    return missing.select("video_id", "batch", "anchor_id")


def j15_kept(spark, sf):
    evaluations, _, _ = anchors.evaluate_batches(batch_answers(spark, sf), batch_items(spark, sf))
    return evaluations.select("video_id", "batch", "anchor_id", "keep_image", "caption", "frame_path")


J15_KEPT = query("""
SELECT video_id, batch, anchor_id, quality = 1 AS keep_image, 'n' || doc_id AS caption, 'f/' || doc_id || '.jpg' AS frame_path
FROM batch_items WHERE kind NOT IN (2, 3)""")

# --- retakes ---------------------------------------------------------------------------------


def rounds(spark, sf):
    """Three rounds per labelled frame; toxic ones ask for a retake for a while, some in vain."""
    n = F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("round")
    rows = t.read(spark, sf, "labels").select("*", n).where("doc_id % 11 <> 4 OR round = 0")
    again = ((F.col("toxic") == 1) | (F.col("doc_id") % 3 == 0)) & (F.col("round") < F.col("doc_id") % 4)
    return rows.select(
        (F.col("doc_id") % 50).alias("video_id"), F.expr("'a' || doc_id").alias("anchor_id"), "round",
        F.expr("CAST(doc_id % 7 AS INT)").alias("srt_id"), (F.col("doc_id") + F.col("round") * 0.5).alias("timestamp"),
        (F.col("quality") == 1).alias("keep_image"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("r"), F.col("round").cast("string"))).otherwise("").alias("reason"),
        again.alias("retake"),
        F.when(again, F.expr("CASE doc_id % 5 WHEN 0 THEN 0D WHEN 1 THEN NULL ELSE doc_id + 10D END")).alias("retake_timestamp"),
    )


define("rounds", """
SELECT doc_id % 50 AS video_id, 'a' || doc_id AS anchor_id, doc_id, round, doc_id + round * 0.5e0 AS timestamp, quality = 1 AS keep_image,
       CASE WHEN doc_id % 2 = 0 THEN 'r' || round ELSE '' END AS reason,
       (toxic = 1 OR doc_id % 3 = 0) AND round < doc_id % 4 AS retake,
       CASE doc_id % 5 WHEN 0 THEN 0e0 WHEN 1 THEN NULL ELSE doc_id + 10e0 END AS rt
FROM labels, (SELECT unnest([0, 1, 2]) AS round) WHERE doc_id % 11 <> 4 OR round = 0""")


def w10(spark, sf):
    final, _ = anchors.resolve_retakes(rounds(spark, sf), 1)
    return final.select("video_id", "anchor_id", "round", "timestamp", "keep_image", "retake", "reason", "forced", "outcome")


W10 = query(f"""
SELECT video_id, anchor_id, round, timestamp, keep_image OR (retake AND round = 1) AS keep_image, false AS retake,
       CASE WHEN retake AND reason = '' THEN CASE round WHEN 1 THEN '{anchors.KEPT_REASON}' ELSE '{anchors.UNSERVED_REASON}' END
            ELSE reason END AS reason,
       retake AND round = 1 AS forced, CASE WHEN NOT retake THEN 'kept' WHEN round = 1 THEN 'forced' ELSE 'unserved' END AS outcome
FROM rounds WHERE round <= 1
QUALIFY row_number() OVER (PARTITION BY video_id, anchor_id
        ORDER BY CASE WHEN NOT retake OR round = 1 THEN round ELSE 9 - round END) = 1""")


def w10_next(spark, sf):
    _, captures = anchors.resolve_retakes(rounds(spark, sf), 2)
    return captures.select("video_id", "anchor_id", "round", "timestamp", "target", "served")


W10_NEXT = query("""
SELECT video_id, anchor_id, round + 1 AS round, coalesce(nullif(rt, 0), timestamp) AS timestamp,
       'retakes/' || anchor_id || printf('_retake_%03d_%.3f.jpg', doc_id % 7, coalesce(nullif(rt, 0), timestamp)) AS target,
       doc_id % 11 <> 4 AS served
FROM rounds WHERE round < 2 AND retake""")

# --- model calls -------------------------------------------------------------------------------


def prompts(spark, sf):
    return t.read_texts(spark, sf).select(
        "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("|"), F.col("text")).alias("prompt")
    )


def measuring_model(batches):
    """Stand-in model: says how long the prompt is."""
    for b in batches:
        yield b.assign(response=["len " + str(len(p)) for p in b["prompt"]])[["doc_id", "response"]]


def unsteady_model(batches):
    """Stand-in model: every fourth document fails at first, every twelfth always."""
    for b in batches:
        out = []
        for doc, prompt in zip(b["doc_id"], b["prompt"]):
            good = doc % 4 != 0 or ("<RAW>bad" in prompt and doc % 3 != 0)
            out.append('{"n": %d}' % doc if good else "bad %d" % doc)
        yield b.assign(response=out)[["doc_id", "response"]]


def _holds_object(answers):
    return answers.where(mo.json_object(F.col("response")).isNotNull())


def m1(spark, sf):
    return inference.infer(prompts(spark, sf), measuring_model, ["doc_id"])


def _with_retries(spark, sf):
    return inference.infer_with_retries(prompts(spark, sf), unsteady_model, ["doc_id"], _holds_object, max_calls=3)


def m2(spark, sf):
    accepted, _, failed = _with_retries(spark, sf)
    return accepted.select("doc_id", "attempt", "response").unionByName(
        failed.select("doc_id", F.lit(None).cast("int").alias("attempt"), F.col("last_response").alias("response"))
    )


M2 = """
SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN 0 WHEN doc_id % 3 <> 0 THEN 1 END AS attempt,
       CASE WHEN doc_id % 12 = 0 THEN 'bad ' || doc_id ELSE '{"n": ' || doc_id || '}' END AS response FROM documents"""


def m3(spark, sf):
    return _with_retries(spark, sf)[1]


M3 = """
SELECT doc_id, a AS attempt, CASE WHEN fails THEN CASE WHEN i = 3 THEN 'exhausted' ELSE 'schema_mismatch' END END AS parse_error,
       CAST(length(CASE WHEN fails THEN 'bad ' || doc_id ELSE '{"n": ' || doc_id || '}' END) AS INTEGER) AS response_chars,
       CASE WHEN fails THEN 'bad ' || doc_id ELSE '{"n": ' || doc_id || '}' END AS response
FROM (SELECT doc_id, i, least(i, 2) AS a, doc_id % 4 = 0 AND (i = 0 OR doc_id % 3 = 0) AS fails
      FROM documents, (SELECT unnest([0, 1, 2, 3]) AS i)
      WHERE i = 0 OR (doc_id % 4 = 0 AND (i = 1 OR doc_id % 3 = 0)))"""


def s13(spark, sf):
    """Failures written to the raw log and read back."""
    path = scratch_path(spark, "raw-log")
    file_io.append_log(_with_retries(spark, sf)[1], path)
    return spark.read.schema(
        "doc_id bigint, attempt int, parse_error string, response_chars int, response string"
    ).json(path)


def f27(spark, sf):
    docs = t.read_texts(spark, sf)
    name = F.concat(F.lit("a"), F.col("doc_id").cast("string"))
    return docs.select(
        "doc_id", inference.text_prompt("Polish this:\n{chunk_text}\nEnd.", F.col("text")).alias("prompt"),
        inference.text_repair_prompt(F.col("text")).alias("repair"),
        inference.vision_repair_prompt(F.col("text")).alias("vision_repair"),
        inference.vision_context(name, F.col("n_chars") / 8.0, F.col("lang"), F.col("source")).alias("context"),
    )


F27 = f"""
SELECT doc_id, 'Polish this:' || chr(10) || text || chr(10) || 'End.' AS prompt,
  '{inference.TEXT_REPAIR[0]}' || text || '{inference.TEXT_REPAIR[1]}' AS repair,
  '{inference.VISION_REPAIR[0]}' || text || '{inference.VISION_REPAIR[1]}' AS vision_repair,
  '{inference.VISION_CONTEXT[0]}a' || doc_id || '{inference.VISION_CONTEXT[1]}' || CAST(n_chars / 8e0 AS VARCHAR)
  || '{inference.VISION_CONTEXT[2]}' || lang || '{inference.VISION_CONTEXT[3]}' || source
  || '{inference.VISION_CONTEXT[4]}' AS context FROM documents"""


def f29(spark, sf):
    msg = t.read(spark, sf, "conversations").withColumn("q", F.to_json(F.array("text")))
    q = F.expr("substr(q, 2, length(q) - 2)")
    wire = F.expr("CASE turn % 5 WHEN 0 THEN 'openai_chat' WHEN 1 THEN 'gemini' WHEN 2 THEN 'anthropic' ELSE 'openai_responses' END")
    body = (
        F.when(F.col("turn") % 5 == 0, F.concat(F.lit('{"choices":[{"message":{"content":'), q, F.lit("}}]}")))
        .when(F.col("turn") % 5 == 1, F.concat(F.lit('{"candidates":[{"content":{"parts":[{"text":'), q, F.lit("}]}}]}")))
        .when(F.col("turn") % 5 == 2, F.concat(F.lit('{"content":[{"text":'), q, F.lit("}]}")))
        .when(F.col("turn") % 5 == 3, F.concat(F.lit('{"output_text":'), q, F.lit("}")))
        .otherwise(F.concat(
            F.lit('{"output":[{"type":"reasoning"},{"type":"message","content":[{"type":"image"},{"type":"text","text":'), q,
            F.lit("}]}]}"),
        ))
    )
    return msg.select("conv_id", "turn", mo.reply_text(wire, body).alias("reply"))


F29 = "SELECT conv_id, turn, text AS reply FROM conversations"


def f30(spark, sf):
    calls = t.read(spark, sf, "events").select(
        "event_id", "event_type",
        F.expr("CAST(CASE event_id % 7 WHEN 0 THEN 200 WHEN 1 THEN 408 WHEN 2 THEN 425 WHEN 3 THEN 429 WHEN 4 THEN 503 WHEN 5 THEN 400 ELSE 401 END AS INT)").alias("status"),
        F.expr("repeat(props || ' ', CAST(event_id % 200 AS INT))").alias("body"),
    )
    s = F.col("status")
    return calls.select(
        "event_id", mo.call_outcome(s).alias("outcome"),
        mo.call_outcome(s, mo.INTENT_RETRYABLE_STATUS).alias("intent_outcome"),
        mo.outcome_message(F.col("event_type"), s, F.col("body")).alias("message"),
    )


F30 = """
SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'ok' WHEN 5 THEN 'fatal' WHEN 6 THEN 'fatal' ELSE 'retryable' END AS outcome,
  CASE event_id % 7 WHEN 0 THEN 'ok' WHEN 2 THEN 'fatal' WHEN 5 THEN 'fatal' WHEN 6 THEN 'fatal' ELSE 'retryable' END AS intent_outcome,
  CASE WHEN event_id % 7 > 0 THEN 'Provider ''' || event_type || ''' returned '
    || CASE event_id % 7 WHEN 1 THEN 408 WHEN 2 THEN 425 WHEN 3 THEN 429 WHEN 4 THEN 503 WHEN 5 THEN 400 ELSE 401 END || ': '
    || CASE WHEN length(b) > 1200 THEN substr(b, 1, 1200) || '…' ELSE b END END AS message
FROM (SELECT event_id, event_type, trim(repeat(props || ' ', event_id % 200)) AS b FROM events)"""

# --- documents -------------------------------------------------------------------------------------


def _document_inputs(spark, sf):
    """Chunks, blogs with global anchors, and one evaluation per requested anchor.

    Every third anchor is judged twice; the later verdict counts.
    """
    ready = _ready(spark, sf)
    blogs = ready.chunks.select(
        *KEYS,
        F.expr("""'  ## Part ' || chunk_index || chr(10) || chr(10) || chr(10) || chr(10) || '[[FRAME:c' || chunk_index || '_a1@5.0]] then [[FRAME:c'
          || chunk_index || '_a2@6.5]] and [[FRAME:zz@1]]' || chr(10)""").alias("blog_markdown"),
    )
    which = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(j).alias("j")) for n in (1, 2) for j in (0, 1)])).alias("w")
    verdicts = ready.chunks.select(*KEYS, "n_segments", which).select(*KEYS, "n_segments", "w.*").where(
        "j = 0 OR (video_id + chunk_index) % 3 = 0"
    )
    evaluations = verdicts.select(
        *KEYS,
        F.expr("'c' || chunk_index || '_a' || n").alias("anchor_id"),
        F.expr("chunk_index * 10 + n + j * 4").cast("long").alias("seq"),
        F.expr("CAST((video_id + n) % (n_segments + 1) AS BIGINT)").alias("srt_id"),
        F.expr("'tmp/' || video_id || '/f' || chunk_index || '_' || n || '.jpg'").alias("frame_path"),
        F.expr("(video_id + chunk_index + n + j) % 4 <> 0").alias("keep_image"),
        F.expr("CASE WHEN n = 1 THEN ' cap ' || j || ' ' ELSE '' END").alias("caption"),
        F.expr("CASE WHEN video_id % 2 = 0 THEN 'one' || chr(10) || ' ' || chr(10) || 'two' ELSE '' END").alias("text_representation"),
    )
    titles = ready.chunks.select("video_id").distinct().withColumn("title", F.concat(F.lit("Lecture "), F.col("video_id").cast("string")))
    return ready, blogs, evaluations, titles


define("verdicts", """
SELECT c.video_id, c.chunk_index, n, 'c' || c.chunk_index || '_a' || n AS anchor_id, c.chunk_index * 10 + n + j * 4 AS seq,
       (c.video_id + n) % (c.n_segments + 1) AS srt_id, 'src/f' || c.chunk_index || '_' || n || '.jpg' AS image,
       (c.video_id + c.chunk_index + n + j) % 4 <> 0 AS keep, CASE WHEN n = 1 THEN 'cap ' || j ELSE '' END AS caption,
       c.video_id % 2 = 0 AS body
FROM chunks c, (SELECT unnest([1, 2]) AS n), (SELECT unnest([0, 1]) AS j)
WHERE j = 0 OR (c.video_id + c.chunk_index) % 3 = 0""")
define("pictures", """
SELECT *, '![图](' || image || ')' AS plain, CASE WHEN caption <> '' AND body THEN chr(10) || chr(10) ELSE '' END AS gap FROM (
  SELECT *, min(seq) OVER (PARTITION BY video_id, anchor_id) AS first_seq,
         row_number() OVER (PARTITION BY video_id, anchor_id ORDER BY seq DESC) AS back FROM verdicts)
WHERE back = 1 AND keep""")
define("offsets", """
SELECT video_id, chunk_index, coalesce(sum(n_segments) OVER (PARTITION BY video_id ORDER BY chunk_index
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM chunks""")


def a11(spark, sf):
    ready, blogs, evaluations, titles = _document_inputs(spark, sf)
    return assemble(ready, blogs, evaluations, titles)[0].select("video_id", "part", "text")


HMS = "printf('%02d:%02d:%02d', CAST(floor({x}) AS BIGINT) // 3600, CAST(floor({x}) AS BIGINT) // 60 % 60, CAST(floor({x}) AS BIGINT) % 60)"
A11 = query(f"""
SELECT video_id, 0 AS part, rtrim(string_agg(piece, chr(10) ORDER BY g, sub), ' ' || chr(10)) || chr(10) AS text FROM (
  SELECT DISTINCT video_id, 0 AS g, -1 AS sub, '# Lecture ' || video_id || chr(10) AS piece FROM chunks
  UNION ALL
  SELECT m.video_id, off + m.srt_id, -1, '> ' || CAST(off + m.srt_id AS BIGINT) || '. **' || {HMS.format(x='m.start')} || ' - '
         || {HMS.format(x='coalesce(nullif(m."end", 0), m.start)')} || '**  ' || chr(10) || '> ' || m.text || chr(10)
  FROM members m JOIN offsets o ON m.video_id = o.video_id AND m.chunk_index = o.chunk_index
  UNION ALL
  SELECT p.video_id, off + p.srt_id, p.first_seq, plain
         || CASE WHEN caption <> '' OR body THEN chr(10) || chr(10) ELSE '' END
         || CASE WHEN caption <> '' THEN '*' || caption || '*' ELSE '' END || gap
         || CASE WHEN body THEN 'one' || chr(10) || ' ' || chr(10) || 'two' ELSE '' END || chr(10)
  FROM pictures p JOIN offsets o ON p.video_id = o.video_id AND p.chunk_index = o.chunk_index
  WHERE off + p.srt_id >= 1)
GROUP BY video_id""")


def a12(spark, sf):
    ready, blogs, evaluations, titles = _document_inputs(spark, sf)
    return assemble(ready, blogs, evaluations, titles)[1].select("video_id", "part", "text")


QUOTED = """coalesce((SELECT plain || CASE WHEN caption <> '' OR body THEN chr(10) || chr(10) ELSE '' END
  || CASE WHEN caption <> '' THEN '> *' || caption || '*' ELSE '' END
  || CASE WHEN caption <> '' AND body THEN chr(10) || '>' || chr(10) ELSE '' END
  || CASE WHEN body THEN '> one' || chr(10) || '>' || chr(10) || '> two' ELSE '' END
  FROM pictures p WHERE p.video_id = c.video_id AND p.anchor_id = 'c' || c.chunk_index || '_a{n}'), '')"""
define("shown_chunks", f"""
SELECT c.video_id, c.chunk_index, rtrim('## Part ' || c.chunk_index || chr(10) || chr(10) || {QUOTED.format(n=1)} || ' then '
       || {QUOTED.format(n=2)} || ' and ') AS text FROM chunks c""")
A12 = query("""
SELECT video_id, 0 AS part, '# Lecture ' || video_id || chr(10) || chr(10)
       || string_agg(text, chr(10) || chr(10) ORDER BY chunk_index) || chr(10) AS text
FROM shown_chunks GROUP BY video_id""")


S11 = f"SELECT 'subtitles' AS name, * FROM ({A11}) UNION ALL SELECT 'blog', * FROM ({A12})"


def j18(spark, sf):
    _, blogs, evaluations, _ = _document_inputs(spark, sf)
    return documents.rendered_chunks(blogs, evaluations)


def s11(spark, sf):
    """Both documents written and read back."""
    ready, blogs, evaluations, titles = _document_inputs(spark, sf)
    out = []
    for name, doc in zip(("subtitles", "blog"), assemble(ready, blogs, evaluations, titles)):
        path = scratch_path(spark, name)
        file_io.write_text_files(doc, path, "md")
        out.append(
            file_io.read_text_files(spark, path, "md").select(
                F.col("video_id").cast("long").alias("video_id"), F.lit(0).alias("part"), "text", F.lit(name).alias("name")
            )
        )
    return out[0].unionByName(out[1])


def a13(spark, sf):
    rows = t.read(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("service"), F.col("props").alias("description"),
        F.col("event_id").alias("seq"),
    )
    return runs.last_per_key(rows, ["run_id", "service"])


A13 = """
SELECT user_id AS run_id, event_type AS service, arg_max(props, event_id) AS description, min(event_id) AS first_seq
FROM events GROUP BY user_id, event_type"""


def a14(spark, sf):
    rows = t.read(spark, sf, "labels").select(
        (F.col("doc_id") % 50).alias("video_id"), F.col("doc_id").alias("chunk_index"), (F.col("toxic") == 1).alias("degraded")
    )
    return documents.chunk_totals(rows)


A14 = """
SELECT t.*, f.doc_id AS failed_chunk FROM (
  SELECT doc_id % 50 AS video_id, count(*) AS chunks_total, count(*) FILTER (WHERE toxic <> 1) AS chunks_succeeded
  FROM labels GROUP BY doc_id % 50) t
LEFT JOIN labels f ON f.toxic = 1 AND f.doc_id % 50 = t.video_id"""

# --- near duplicates ---------------------------------------------------------------------------------


def hashes(spark, sf):
    """Sign-bit hashes of the embeddings, each with two near copies and an exact one."""
    bits = F.expr("""aggregate(sequence(0, 62), 0L,
      (acc, i) -> acc | CASE WHEN element_at(embedding, i + 1) > 0 THEN shiftleft(1L, i) ELSE 0L END)""")
    copies = F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("c")
    rows = t.read(spark, sf, "embeddings").select("vec_id", "label", bits.alias("h"), copies)
    mask = F.expr("CASE c WHEN 1 THEN shiftleft(1L, CAST(vec_id % 60 AS INT)) WHEN 2 THEN shiftleft(7L, CAST(vec_id % 60 AS INT)) ELSE 0L END")
    return rows.select(
        F.col("label").alias("video_id"), (F.col("vec_id") * 4 + F.col("c")).alias("frame_id"),
        F.expr("'f/' || (vec_id * 4 + c) || '.jpg'").alias("path"), (F.col("vec_id") * 4.0 + F.col("c")).alias("timestamp_sec"),
        F.when((F.col("vec_id") % 50 != 49) & (F.col("label") != 3), F.col("h").bitwiseXOR(mask)).alias("phash"),
    )


define("hashes", """
SELECT label AS video_id, vec_id * 4 + c AS frame_id, vec_id * 4e0 + c AS timestamp_sec,
       CASE WHEN vec_id % 50 <> 49 AND label <> 3 THEN xor(h, CASE c WHEN 1 THEN 1::BIGINT << (vec_id % 60) WHEN 2 THEN 7::BIGINT << (vec_id % 60) ELSE 0 END) END AS phash
FROM (SELECT vec_id, label, CAST(list_sum(list_transform(range(0, 63),
        lambda i: CASE WHEN embedding[i + 1] > 0 THEN 1::BIGINT << i ELSE 0 END)) AS BIGINT) AS h FROM embeddings),
     (SELECT unnest([0, 1, 2, 3]) AS c)""")
define("hash_order", """
SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY timestamp_sec, frame_id) AS r FROM hashes WHERE phash IS NOT NULL""")


def _greedy_sql(d_max: int, limit: int) -> str:
    return query("""
SELECT video_id, frame_id FROM greedy_{d} WHERE kept_now AND len(kept) <= {m}
UNION ALL
SELECT video_id, arg_min(frame_id, timestamp_sec) FROM hashes GROUP BY video_id HAVING count(phash) = 0""".format(d=d_max, m=limit))


for _d in (3, 19):
    define(f"greedy_{_d}", f"""
SELECT video_id, r, frame_id, [phash] AS kept, true AS kept_now FROM hash_order WHERE r = 1
UNION ALL
SELECT h.video_id, h.r, h.frame_id, CASE WHEN n = 0 THEN list_append(g.kept, h.phash) ELSE g.kept END, n = 0
FROM greedy_{_d} g JOIN hash_order h ON h.video_id = g.video_id AND h.r = g.r + 1,
     LATERAL (SELECT len(list_filter(g.kept, lambda k: bit_count(xor(k, h.phash)) <= {_d})) AS n)""")


def d1(spark, sf):
    return dedup.deduplicate(hashes(spark, sf), 0.95, 200).select("video_id", "frame_id")


def d1_loose(spark, sf):
    return dedup.deduplicate(hashes(spark, sf), 0.7, 25).select("video_id", "frame_id")


def d2(spark, sf):
    return dedup.unhashed(hashes(spark, sf)).select("video_id", "frame_id", "bucket", "stage")


def d3(spark, sf):
    """Videos without any hash keep their first frame."""
    unhashed = hashes(spark, sf).withColumn("phash", F.when(F.col("video_id") % 2 == 0, F.col("phash")))
    return dedup.deduplicate(unhashed, 0.0, 5).select("video_id", "frame_id")


D3 = query("""
SELECT video_id, frame_id FROM hashes WHERE video_id % 2 = 0 AND phash IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY timestamp_sec) = 1
UNION ALL SELECT video_id, min(frame_id) FROM hashes WHERE video_id % 2 = 1 GROUP BY video_id""")

QUERIES = {
    "f19_anchors": (f19, F19),
    "f20_global_anchors": (f20, F20),
    "f22_json_objects": (f22, F22),
    "f23_strict_booleans": (f23, _expected([(x, (e,)) for x, e in BOOLS], f"event_id % {len(BOOLS)}", ["flag"], "event_id", "events")),
    "f24_frame_requests": (f24, _expected(REQUESTS, f"event_id % {len(REQUESTS)}", ["anchor_id", "srt_id", "timestamp", "request_type", "source_frame_path", "reason"], "event_id", "events")),
    "f25_frame_decisions": (f25, _expected(DECISIONS, f"event_id % {len(DECISIONS)}", ["frame_path", "keep_image", "content_type", "caption", "text_representation", "reason", "retake", "retake_timestamp"], "event_id", "events")),
    "f27_prompts": (f27, F27),
    "f29_reply_texts": (f29, F29),
    "f30_call_outcomes": (f30, F30),
    "j9_strict_answers": (j9, J9),
    "j10_repaired_requests": (j10, J10),
    "u4_id_sets": (u4, U4),
    "w7_first_markers": (w7, W7),
    "j11_decision_match": (j11, J11),
    "j15_batch_verdicts": (j15, J15),
    "j15_missing_items": (j15_missing, query("SELECT video_id, batch, anchor_id FROM batch_items WHERE kind IN (2, 3)")),
    "j15_recovered": (j15_kept, J15_KEPT),
    "w10_retakes": (w10, W10),
    "w10_retake_captures": (w10_next, W10_NEXT),
    "m1_inference": (m1, "SELECT doc_id, 'len ' || (length(text) + 1 + length('' || doc_id)) AS response FROM documents"),
    "m2_attempt_rounds": (m2, M2),
    "m3_attempt_log": (m3, M3),
    "s13_raw_log": (s13, f"SELECT * FROM ({M3}) WHERE parse_error IS NOT NULL"),
    "a11_subtitle_document": (a11, A11),
    "a12_blog_document": (a12, A12),
    "j18_rendered_chunks": (j18, query("SELECT * FROM shown_chunks")),
    "s11_document_sink": (s11, S11),
    "a13_last_per_key": (a13, A13),
    "a14_chunk_totals": (a14, A14),
    "d1_dedup_tight": (d1, _greedy_sql(3, 200)),
    "d1_dedup_loose": (d1_loose, _greedy_sql(19, 25)),
    "d2_unhashed": (d2, query("SELECT video_id, frame_id, 'skipped_frames' AS bucket, 'keyframe_dedup' AS stage FROM hashes WHERE phash IS NULL")),
    "d3_first_frame": (d3, D3),
}
