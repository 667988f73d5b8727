"""Reading and checking what models answer."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lectern.functions.text import let, strip

# Names and codes that decide results.
REQUEST_TYPES = ["reuse", "new_capture"]
CONTENT_TYPES = [
    "text_slide", "terminal", "code", "diagram", "formula", "table",
    "screenshot", "face", "blank", "transition", "other",
]
RETRYABLE_STATUS = [408, 425, 429]
INTENT_RETRYABLE_STATUS = [408, 429]
MESSAGE_CHARS = 1200
ANCHOR = r"\[\[FRAME:([A-Za-z0-9_-]+)@(\d+(?:\.\d+)?)\]\]"
IMAGE_TYPES = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png",
    "gif": "image/gif", "webp": "image/webp",
}

REQUEST_STRUCT = (
    "struct<anchor_id:string,srt_id:int,timestamp:double,"
    "request_type:string,source_frame_path:string,reason:string>"
)

_DIGITS = r"[0-9]+(_[0-9]+)*"
NUMBER = rf"\A[+-]?({_DIGITS}\.?({_DIGITS})?|\.{_DIGITS})([eE][+-]?{_DIGITS})?\z"

_TOKENS = re.compile(r'"(?:\\.|[^"\\])*(?:"|\\?\Z)|[{}]', re.DOTALL)


def _balanced(raw: str) -> str | None:
    depth = 0
    for token in _TOKENS.finditer(raw, max(raw.find("{"), 0)):
        if token[0] == "{":
            depth += 1
        elif token[0] == "}":
            depth -= 1
            if depth == 0:
                return raw[raw.find("{"): token.end()]
    return None


def _salvage(raw: str | None) -> str | None:
    """JSON text of the object in ``raw``, for texts the JVM parser refuses."""
    if not raw or "{" not in raw:
        return None
    first = _balanced(raw)
    if first is None:
        return None
    for candidate in (first, raw[raw.find("{"): raw.rfind("}") + 1]):
        try:
            value = json.loads(candidate, parse_constant=lambda _: None)
            text = json.dumps(value, ensure_ascii=False)
        except (ValueError, RecursionError):
            continue
        # A lone surrogate cannot leave Python as UTF-8.
        return text.encode("utf-8", "replace").decode("utf-8")
    return None


@F.pandas_udf(StringType())
def _salvage_udf(raw: pd.Series) -> pd.Series:
    return raw.map(_salvage, na_action="ignore")


def json_object(raw: Column) -> Column:
    """The first JSON object in a model answer, as a variant; null if there is none.

    Starting the parser at the first brace handles prose and code fences on the
    JVM. Only texts it refuses (duplicate keys, NaN, a broken first object) are
    sent to Python; the others reach that stage as nulls.
    """
    at = F.instr(raw, "{")
    direct = F.try_parse_json(F.when(at > 0, F.substr(raw, at)))
    rest = _salvage_udf(F.when((at > 0) & direct.isNull(), raw))
    return F.coalesce(direct, F.try_parse_json(rest))


def json_objects(rows: DataFrame, raw: str, name: str = "obj") -> DataFrame:
    """Rows with ``json_object`` of a text column, as a table of two branches.

    Texts that the JVM parser takes never come near Python; only the rows with refused
    ones run through it. The rows are read twice, so a costly table is written before.
    """
    text = F.col(raw)
    at = F.instr(text, "{")
    direct = F.try_parse_json(F.when(at > 0, F.substr(text, at)))
    refused = F.coalesce((at > 0) & direct.isNull(), F.lit(False))
    return (
        rows.where(~refused).withColumn(name, direct)
        .unionByName(rows.where(refused).withColumn(name, F.try_parse_json(_salvage_udf(text))))
    )


def _fields(obj: Column, *names: str) -> Column:
    """Kind and text of each field: kind is null when the field is absent.

    The object is taken apart once, however many fields are asked for.
    """

    def field(value: Column, name: str) -> Column:
        return F.struct(
            F.schema_of_variant(value).alias("kind"), F.try_variant_get(value, "$", "string").alias("text")
        ).alias(name)

    parts = F.try_variant_get(obj, "$", f"struct<{','.join(f'{n}:variant' for n in names)}>")
    return let(parts, lambda p: F.struct(*[field(p[n], n) for n in names]))


def _is_object(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))


def _string(field: Column) -> Column:
    """The field if it is a JSON string."""
    return F.when(field["kind"] == "STRING", field["text"])


def _text(field: Column, default: Column) -> Column:
    """The field as text, whatever its type; ``default`` when absent."""
    return F.when(field["kind"].isNull(), default).otherwise(F.coalesce(field["text"], F.lit("None")))


def _number(field: Column) -> Column:
    """The field as a finite number, from a JSON number, bool or numeric string."""
    text = strip(field["text"])
    # A string counts in plain or exponent form; the JVM would also take type suffixes.
    text = F.when(field["kind"] != "STRING", text).when(text.rlike(NUMBER), F.replace(text, F.lit("_"), F.lit("")))
    number = F.when(
        field["kind"] == "BOOLEAN", (field["text"] == "true").cast("double")
    ).otherwise(text.try_cast("double"))
    return F.when(F.abs(number) < float("inf"), number)


def _whole(field: Column) -> Column:
    """The field as an integer: numbers truncate, strings must be whole."""
    return F.when(
        (field["kind"] != "STRING") | field["text"].rlike(r"\A\s*[+-]?\d+\s*\z"), _number(field).try_cast("int")
    )


def _bool(field: Column) -> Column:
    word = F.lower(strip(field["text"]))
    return F.when(
        field["kind"].isin("BOOLEAN", "STRING"), F.when(word == "true", True).when(word == "false", False)
    )


def strict_bool(obj: Column, name: str) -> Column:
    """JSON boolean or the strings true/false; anything else is null."""
    return let(_fields(obj, name), lambda f: _bool(f[name]))


def frame_request(item: Column) -> Column:
    """One frame request, or null when it breaks a rule."""

    def read(f: Column) -> Column:
        return F.struct(
            _string(f["anchor_id"]).alias("anchor_id"),
            _whole(f["srt_id"]).alias("srt_id"),
            _number(f["timestamp"]).alias("timestamp"),
            _string(f["request_type"]).alias("request_type"),
            _string(f["source_frame_path"]).alias("source_frame_path"),
            _text(f["reason"], F.lit("")).alias("reason"),
            (F.coalesce(f["source_frame_path"]["kind"], F.lit("VOID")) == "VOID").alias("no_path"),
        )

    def check(r: Column) -> Column:
        path_ok = F.when(
            r["request_type"] == "reuse", F.coalesce(r["source_frame_path"], F.lit("")) != ""
        ).otherwise(r["no_path"])
        valid = (
            (r["anchor_id"] != "") & (r["srt_id"] >= 1) & (r["timestamp"] >= 0)
            & r["request_type"].isin(REQUEST_TYPES) & path_ok
        )
        return F.when(valid, r.dropFields("no_path"))

    names = ["anchor_id", "srt_id", "timestamp", "request_type", "source_frame_path", "reason"]
    return let(let(_fields(item, *names), read), check)


def frame_decision(item: Column, frame_path: Column) -> Column:
    """One frame decision, or null when it breaks a rule.

    A ``frame`` in the decision replaces the path that was asked about.
    """

    def flag(field: Column) -> Column:
        return F.when(field["kind"].isNull(), False).otherwise(_bool(field))

    def read(f: Column) -> Column:
        return F.struct(
            _text(f["frame"], frame_path).alias("frame_path"),
            flag(f["keep_image"]).alias("keep_image"),
            F.when(f["content_type"]["text"].isin(CONTENT_TYPES), f["content_type"]["text"])
            .otherwise("other").alias("content_type"),
            _text(f["caption"], F.lit("")).alias("caption"),
            _text(f["text_representation"], F.lit("")).alias("text_representation"),
            _text(f["reason"], F.lit("")).alias("reason"),
            flag(f["retake"]).alias("retake"),
            F.when(flag(f["retake"]), _number(f["retake_timestamp"])).alias("retake_timestamp"),
        )

    def check(r: Column) -> Column:
        time_ok = ~r["retake"] | F.coalesce(r["retake_timestamp"] >= 0, F.lit(False))
        return F.when(r["keep_image"].isNotNull() & r["retake"].isNotNull() & time_ok, r)

    names = [
        "frame", "keep_image", "content_type", "caption", "text_representation", "reason",
        "retake", "retake_timestamp",
    ]
    return let(item, lambda i: F.when(_is_object(i), let(let(_fields(i, *names), read), check)))


def items(obj: Column, name: str) -> Column:
    """A list field as an array of variants; null when it is not a list."""
    return F.try_variant_get(obj, f"$.{name}", "array<variant>")


def string_field(obj: Column, name: str) -> Column:
    """A field if it is a JSON string."""
    return let(_fields(obj, name), lambda f: _string(f[name]))


def anchors(markdown: Column) -> Column:
    """All anchors of a text in order, as (anchor_id, timestamp)."""
    ids = F.regexp_extract_all(markdown, F.lit(ANCHOR), 1)
    times = F.regexp_extract_all(markdown, F.lit(ANCHOR), 2)
    return F.zip_with(
        ids, times, lambda i, t: F.struct(i.alias("anchor_id"), t.cast("double").alias("timestamp"))
    )


def global_anchor_text(markdown: Column, chunk: Column) -> Column:
    """Anchor ids in a text prefixed with their chunk."""
    return F.regexp_replace(
        markdown, F.lit(ANCHOR), F.concat(F.lit("[[FRAME:c"), chunk, F.lit("_$1@$2]]"))
    )


def global_anchor_id(anchor: Column, chunk: Column) -> Column:
    return F.concat(F.lit("c"), chunk, F.lit("_"), anchor)


def reply_text(wire: Column, body: Column) -> Column:
    """Answer text out of a stored response body, by wire format."""
    obj = F.try_parse_json(body)

    def at(path: str) -> Column:
        return F.try_variant_get(obj, path, "string")

    parts = F.flatten(
        F.transform(
            F.filter(
                F.coalesce(F.try_variant_get(obj, "$.output", "array<variant>"), F.array().cast("array<variant>")),
                lambda o: F.try_variant_get(o, "$.type", "string") == "message",
            ),
            lambda o: F.coalesce(
                F.try_variant_get(o, "$.content", "array<variant>"), F.array().cast("array<variant>")
            ),
        )
    )
    first_part = F.get(
        F.filter(parts, lambda p: F.try_variant_get(p, "$.type", "string").isin("output_text", "text")),
        F.lit(0),
    )
    return (
        F.when(wire == "openai_chat", at("$.choices[0].message.content"))
        .when(wire == "gemini", at("$.candidates[0].content.parts[0].text"))
        .when(wire == "anthropic", at("$.content[0].text"))
        .when(
            wire == "openai_responses",
            F.coalesce(at("$.output_text"), F.when(
                first_part.isNotNull(),
                F.coalesce(F.try_variant_get(first_part, "$.text", "string"), F.lit("")),
            )),
        )
    )


def call_outcome(status: Column, retryable: list[int] | None = None) -> Column:
    """ok, retryable or fatal, by HTTP status."""
    codes = RETRYABLE_STATUS if retryable is None else retryable
    return (
        F.when(status == 200, "ok")
        .when(status.isin(codes) | (status >= 500), "retryable")
        .otherwise("fatal")
    )


def outcome_message(provider: Column, status: Column, body: Column) -> Column:
    detail = strip(F.coalesce(body, F.lit("")))
    detail = F.when(
        F.length(detail) > MESSAGE_CHARS,
        F.concat(F.substr(detail, F.lit(1), F.lit(MESSAGE_CHARS)), F.lit("…")),
    ).otherwise(detail)
    return F.when(
        status != 200,
        F.concat(
            F.lit("Provider '"), provider, F.lit("' returned "), status.cast("string"), F.lit(": "), detail
        ),
    )


def image_type(path: Column) -> Column:
    """Media type by suffix; unknown suffixes read as JPEG."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]*)\z", 1))
    pairs = [F.lit(x) for kv in IMAGE_TYPES.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), suffix), F.lit("image/jpeg"))
