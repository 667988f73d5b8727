"""Model answers: extraction, strict and lenient checks, batches, retakes, retries."""

import json

import pytest
from helpers import value
from pyspark.sql import functions as F

from lectern.functions import model_output as mo
from lectern.operators import anchors, documents, inference
from lectern.sources import files

FENCED = 'Here:\n```json\n{"blog_markdown": "code:\\n```python\\nprint({1})\\n```\\nend", "n": 1}\n```\n'


@pytest.mark.parametrize(
    "raw,want",
    [
        ('{"a": 1}', {"a": 1}),
        (FENCED, {"blog_markdown": "code:\n```python\nprint({1})\n```\nend", "n": 1}),
        ('{"a": "}{"} trailing {x}', {"a": "}{"}),
        ('{"a": 1} {"a": 2}', {"a": 1}),
        ('{"a": 1, "a": 2}', {"a": 2}),
        ('{"a": NaN}', {"a": None}),
        ('[{"a": {"b": "\\""}}]', {"a": {"b": '"'}}),
        ("only prose", None), ("", None), (None, None), ('{"a": 1', None), ('{"a": "open}', None), ("{bad} {worse}", None),
        ('{x} and {"a": 1}', None),
        ('{"a": ' + "[" * 200_000 + "]" * 200_000 + "}", None),
        ('{"a": 1, "a": "\\ud800x"}', {"a": "?x"}),
    ],
)
def test_json_object(spark, raw, want):
    got = value(spark, F.to_json(mo.json_object(F.lit(raw).cast("string"))))
    assert (json.loads(got) if got else None) == want


@pytest.mark.parametrize(
    "raw,want",
    [("12.5", 12.5), ('"12.5"', 12.5), ('"\\t1_0 "', 10.0), ('"12.5d"', None), ('"0x1p3"', None), ('".5e1"', 5.0), ('"NaN"', None), ("true", 1.0), ("null", None)],
)
def test_numbers(spark, raw, want):
    field = mo._fields(F.parse_json(F.lit(f'{{"n": {raw}}}')), "n")
    assert value(spark, mo.let(field, lambda f: mo._number(f["n"]))) == want


@pytest.mark.parametrize("raw,want", [('"true\\n"', True), ('"\\tFALSE"', False), ('"\\u3000true"', True), ("1", None)])
def test_strict_booleans_strip(spark, raw, want):
    assert value(spark, mo.strict_bool(F.parse_json(F.lit(f'{{"n": {raw}}}')), "n")) == want


BLOG = {"blog_markdown": "x [[FRAME:a1@53.0]] y [[FRAME:a2@60]]", "frame_requests": [
    {"anchor_id": "a1", "srt_id": 1, "timestamp": 53.0, "request_type": "reuse", "source_frame_path": "p1", "reason": "r"},
    {"anchor_id": "a2", "srt_id": 2, "timestamp": 60, "request_type": "new_capture", "source_frame_path": None},
]}


def changed(**edits):
    blog = json.loads(json.dumps(BLOG))
    for key, val in edits.items():
        index, field = key[1:].split("_", 1)
        blog["frame_requests"][int(index)][field] = val
    return json.dumps(blog)


@pytest.fixture
def setting(table):
    chunks = table("video_id int, chunk_index int, n_segments long", *[(1, i, 2) for i in range(20)])
    placed = table("video_id int, chunk_index int, path string", *[(1, i, "p1") for i in range(20)])
    numbered = table(
        "video_id int, chunk_index int, srt_id long, start double, `end` double",
        *[(1, i, j, s, s + 10.0) for i in range(20) for j, s in ((1, 0.0), (2, 50.0))],
    )
    return chunks, placed, numbered


ANSWERS = [
    (json.dumps(BLOG), True),
    (changed(r0_timestamp=53.5), False),
    (changed(r0_source_frame_path="unknown"), False),
    (changed(r0_srt_id=3), False),
    (changed(r0_anchor_id="a9"), False),
    (json.dumps({**BLOG, "frame_requests": BLOG["frame_requests"][:1]}), False),
    (json.dumps({**BLOG, "frame_requests": BLOG["frame_requests"] + BLOG["frame_requests"][:1]}), False),
    (json.dumps({**BLOG, "blog_markdown": " "}), False),
    (json.dumps({**BLOG, "frame_requests": {}}), False),
    (json.dumps({"blog_markdown": "no pictures", "frame_requests": []}), True),
    ("garbage", False),
]


def test_strict(table, setting):
    chunks, placed, _ = setting
    rows = table("video_id int, chunk_index int, response string", *[(1, i, r) for i, (r, _) in enumerate(ANSWERS)])
    got = {r.chunk_index: r.valid for r in anchors.strict_answers(anchors.read_answers(rows), chunks, placed).collect()}
    assert got == {i: ok for i, (_, ok) in enumerate(ANSWERS)}


def test_lenient(table, setting):
    chunks, placed, numbered = setting
    rows = table("video_id int, chunk_index int, response string", *[(1, i, r) for i, (r, _) in enumerate(ANSWERS)])
    fixed = anchors.repaired_requests(anchors.read_answers(rows), numbered, chunks, placed).collect()
    got = {(r.chunk_index, r.anchor_id): (r.srt_id, r.timestamp, r.request_type, r.source_frame_path, r.reason) for r in fixed}
    done, redo = anchors.COMPLETED_REASON, "53.0".join(anchors.RECAPTURE_REASON)
    assert got[0, "a1"] == (1, 53.0, "reuse", "p1", "r")
    assert got[0, "a2"] == (2, 60.0, "new_capture", None, done)
    assert got[1, "a1"] == (1, 53.0, "reuse", "p1", "r")  # the marker's time wins
    assert got[2, "a1"] == (1, 53.0, "new_capture", None, redo)
    assert got[3, "a1"] == (2, 53.0, "reuse", "p1", "r")  # nearest segment
    assert got[4, "a1"] == (2, 53.0, "new_capture", None, done)
    assert got[5, "a2"] == (2, 60.0, "new_capture", None, done)
    assert got[8, "a1"] == (2, 53.0, "new_capture", None, done)
    assert {c for c, _ in got} == {0, 1, 2, 3, 4, 5, 6, 8}


def test_global_anchors(spark):
    assert value(spark, mo.global_anchor_text(F.lit("x [[FRAME:a1@53.0]] [[FRAME:b c@1]]"), F.lit("3"))) == "x [[FRAME:c3_a1@53.0]] [[FRAME:b c@1]]"


ITEMS = "video_id int, batch int, anchor_id string, srt_id int, frame_path string, timestamp double"


def test_batches(table):
    items = table(
        ITEMS, (1, 0, "c1_a1", 1, "p1", 1.0), (1, 0, "c1_a2", 2, "p2", 2.0), (1, 1, "c1_a3", 1, "p3", 1.0),
        (1, 2, "c1_a4", 1, "p4", 1.0), (1, 2, "c2_a4", 1, "p5", 1.0), (1, 3, "c1_a6", 1, "p6", 1.0),
    )
    answers = table(
        "video_id int, batch int, response string",
        (1, 0, '{"decisions":[{"anchor_id":"a1","keep_image":"false"},{"anchor_id":"c1_a2","keep_image":true,"frame":"q"}]}'),
        (1, 1, '{"decisions":[{"anchor_id":"a3","keep_image":"?"},{"anchor_id":"a3","keep_image":true},7]}'),
        (1, 2, '{"decisions":[{"anchor_id":"a4","keep_image":true},{"anchor_id":"c2_a4"}]}'),
        (1, 3, "sorry"),
    )
    found, missing, verdicts = anchors.evaluate_batches(answers, items)
    assert {(r.anchor_id, r.keep_image, r.frame_path) for r in found.collect()} == {
        ("c1_a1", False, "p1"), ("c1_a2", True, "q"), ("c1_a3", True, "p3"), ("c2_a4", False, "p5"),
    }
    assert {r.anchor_id for r in missing.collect()} == {"c1_a4", "c1_a6"}
    assert {r.batch: r.verdict for r in verdicts.collect()} == {0: "strict", 1: "repaired", 2: "partial", 3: "rejected"}


ROUNDS = (
    "video_id int, anchor_id string, round int, srt_id int, timestamp double, keep_image boolean, "
    "reason string, retake boolean, retake_timestamp double"
)


def test_retakes(table):
    rows = table(
        ROUNDS, (1, "a", 0, 1, 5.0, False, "", True, 7.0), (1, "a", 1, 1, 7.0, False, "", True, 8.0),
        (1, "b", 0, 2, 5.0, False, "no", False, None), (1, "c", 0, 3, 5.0, False, "dark", True, 0.0), (1, "c", 1, 3, 5.0, True, "ok", False, None),
        (1, "d", 0, 4, 9.0, False, "", True, 6.0), (1, "e", 0, 5, 9.0, False, "blurred", True, None),
    )
    final, captures = anchors.resolve_retakes(rows, 1)
    got = {r.anchor_id: (r["round"], r.keep_image, r.retake, r.retake_timestamp, r.reason, r.forced) for r in final.collect()}
    assert got == {
        "a": (1, True, False, None, anchors.KEPT_REASON, True), "b": (0, False, False, None, "no", False),
        "c": (1, True, False, None, "ok", False),
        # The frame never came: the evaluation stays, with a reason, and the frame is still wanted.
        "d": (0, False, False, 6.0, anchors.UNSERVED_REASON, False), "e": (0, False, False, None, "blurred", False),
    }
    assert {r.anchor_id: r.outcome for r in final.collect()} == {
        "a": "forced", "b": "kept", "c": "kept", "d": "unserved", "e": "unserved",
    }
    assert {(r.anchor_id, r.timestamp, r.target, r.served) for r in captures.collect()} == {
        ("a", 7.0, "retakes/a_retake_001_7.000.jpg", True), ("c", 5.0, "retakes/c_retake_003_5.000.jpg", True),
        ("d", 6.0, "retakes/d_retake_004_6.000.jpg", False), ("e", 9.0, "retakes/e_retake_005_9.000.jpg", False),
    }
    none, _ = anchors.resolve_retakes(rows, 0)
    assert {r.anchor_id: r.forced for r in none.collect()} == {"a": True, "b": False, "c": True, "d": True, "e": True}


def test_only_refused_texts_reach_python(table):
    raws = ['{"a": 1}', 'so: {"a": 2} and', '{"a": 1, "a": 3}', "none", "{broken", None, '{"a": NaN}', ""]
    rows = table("id int, raw string", *enumerate(raws))
    out = mo.json_objects(rows, "raw")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    accepted, refused = plan.split("\n:- ")[1].split("\n+- ")[0], plan.split("\n+- ")[1]
    assert "ArrowEvalPython" not in accepted and "ArrowEvalPython" in refused
    got = {r.id: r.o for r in out.select("id", F.to_json("obj").alias("o")).collect()}
    want = {r.id: r.o for r in rows.select("id", F.to_json(mo.json_object(F.col("raw"))).alias("o")).collect()}
    assert got == want and len(got) == len(raws)


def refusing(batches):
    for b in batches:
        yield b.assign(response=["bad"] * len(b))[["doc_id", "response"]]


def silent(batches):
    for b in batches:
        yield b.assign(response=[None if p == "quiet" else '{"p": 1}' for p in b["prompt"]])[["doc_id", "response"]]


def accept(rows):
    return rows.where(mo.json_object(F.col("response")).isNotNull())


def test_retry_log(spark, table, tmp_path):
    from pyspark import cloudpickle
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    cloudpickle.register_pickle_by_value(mo)
    prompts = table("doc_id int, prompt string", (1, "x"))
    accepted, log, failed = inference.infer_with_retries(prompts, refusing, ["doc_id"], accept, max_calls=3)
    assert accepted.count() == 0 and failed.count() == 1
    assert [(r.attempt, r.parse_error) for r in log.collect()] == [
        (0, "schema_mismatch"), (1, "schema_mismatch"), (2, "schema_mismatch"), (2, "exhausted"),
    ]
    files.append_log(log, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_silent_model(table):
    from pyspark import cloudpickle
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    prompts = table("doc_id int, prompt string", (1, "quiet"), (2, "say"))
    accepted, log, failed = inference.infer_with_retries(prompts, silent, ["doc_id"], accept, max_calls=2, parallelism=2)
    assert [(r.doc_id, r.attempt) for r in accepted.collect()] == [(2, 0)]
    assert [r.doc_id for r in failed.collect()] == [1]
    assert [(r.doc_id, r.parse_error) for r in log.collect()] == [(2, None)]


EVALUATIONS = (
    "video_id int, anchor_id string, seq long, srt_id long, frame_path string, keep_image boolean, "
    "caption string, text_representation string"
)


def test_documents(table):
    segments = table("video_id int, srt_id long, text string, start double, `end` double", (1, 1, "hello", 0.0, 5.0), (1, 2, "bye", 65.0, None))
    evaluations = table(
        EVALUATIONS, (1, "c0_a1", 1, 1, "tmp/f1.jpg", True, " cap ", "line\n\nmore"), (1, "c0_a2", 2, 1, "tmp/f2.jpg", False, "", ""),
        (1, "c0_a3", 3, 2, "f3.jpg", False, "", ""), (1, "c0_a3", 4, 2, "f3.jpg", True, "", ""),
    )
    titles = table("video_id int, title string", (1, "T"))
    assert documents.subtitle_document(segments, evaluations, titles).first()["text"] == (
        "# T\n\n> 1. **00:00:00 - 00:00:05**  \n> hello\n\n![图](src/f1.jpg)\n\n*cap*\n\nline\n\nmore\n\n"
        "> 2. **00:01:05 - 00:01:05**  \n> bye\n\n![图](src/f3.jpg)\n"
    )
    blogs = table(
        "video_id int, chunk_index int, blog_markdown string",
        (1, 0, " A [[FRAME:c0_a1@1.0]]\n\n\n\nB [[FRAME:c0_a2@2]][[FRAME:zz@3]] "), (1, 1, "C [[FRAME:c0_a3@3]]"),
    )
    assert documents.blog_document(blogs, evaluations, titles).first()["text"] == (
        "# T\n\nA ![图](src/f1.jpg)\n\n> *cap*\n>\n> line\n>\n> more\n\nB\n\nC ![图](src/f3.jpg)\n"
    )
