"""Calling a user-supplied model function over a table, with attempt rounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.session import cut_lineage

Batches = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]

# Default wording; callers may pass their own.
TEXT_REPAIR = (
    "Your last answer could not be read as the JSON that was asked for. Send the whole corrected"
    " JSON object and nothing else.\n\nLast answer:\n<RAW>",
    "</RAW>\n",
)
VISION_REPAIR = (
    "Your last list of decisions could not be read as JSON. Send all decisions again as one JSON"
    " object, without comments.\n\n<RAW>",
    "</RAW>\n",
)
VISION_CONTEXT = ("\nAnchor [[FRAME:", "@", "]]\nSubtitle: ", "\nImage: ", "\n")


def text_repair_prompt(response: Column, wording: tuple[str, str] = TEXT_REPAIR) -> Column:
    return F.concat(F.lit(wording[0]), response, F.lit(wording[1]))


def vision_repair_prompt(response: Column, wording: tuple[str, str] = VISION_REPAIR) -> Column:
    return F.concat(F.lit(wording[0]), response, F.lit(wording[1]))


def text_prompt(template: str, annotated: Column) -> Column:
    """A prompt template with ``{chunk_text}`` filled in."""
    head, tail = template.split("{chunk_text}", 1)
    return F.concat(F.lit(head), annotated, F.lit(tail))


def vision_context(
    anchor_id: Column, timestamp: Column, subtitle: Column, path: Column,
    wording: tuple[str, str, str, str, str] = VISION_CONTEXT,
) -> Column:
    """The text block that precedes one image of a vision request."""
    a, b, c, d, e = (F.lit(x) for x in wording)
    return F.concat(a, anchor_id, b, timestamp.cast("string"), c, subtitle, d, path, e)


def infer(prompts: DataFrame, fn: Batches, keys: list[str], parallelism: int | None = None) -> DataFrame:
    """Run ``fn`` over Arrow batches of (keys, prompt); it returns (keys, response).

    ``parallelism`` bounds the number of calls in flight.
    """
    rows = prompts.select(*keys, "prompt")
    if parallelism:
        rows = rows.repartition(parallelism)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["response string"])
    return rows.mapInPandas(fn, schema)


def infer_with_retries(
    prompts: DataFrame,
    fn: Batches,
    keys: list[str],
    accept: Callable[[DataFrame], DataFrame],
    *,
    max_calls: int = 3,
    repair: Callable[[Column], Column] = text_repair_prompt,
    parallelism: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted answers, attempt log, rows still without a valid answer).

    ``accept`` takes (keys, response) rows and returns the keys that passed.
    Each round calls the model for the open rows only and is written before it
    is used, so a lost executor never repeats a paid call of an earlier round.
    A row without any response is asked again with the prompt it had.
    """
    if max_calls < 1:
        raise ValueError("max_calls must be at least 1")
    open_rows = prompts.select(*keys, "prompt", F.lit(None).cast("string").alias("last_response"))
    accepted, log = [], []
    for attempt in range(max_calls):
        answers = cut_lineage(infer(open_rows, fn, keys, parallelism))
        good = cut_lineage(accept(answers.where("response IS NOT NULL")).select(*keys).distinct())
        passed = answers.join(good, keys, "left_semi")
        accepted.append(passed.withColumn("attempt", F.lit(attempt)))
        failed = answers.join(good, keys, "left_anti")
        for rows, error in ((passed, None), (failed.where("response IS NOT NULL"), "schema_mismatch")):
            log.append(
                rows.select(
                    *keys,
                    F.lit(attempt).alias("attempt"),
                    F.lit(error).cast("string").alias("parse_error"),
                    F.length("response").alias("response_chars"),
                    "response",
                )
            )
        open_rows = cut_lineage(
            open_rows.join(good, keys, "left_anti")
            .join(failed.where("response IS NOT NULL"), keys, "left")
            .select(
                *keys,
                F.when(F.col("response").isNotNull(), repair(F.col("response"))).otherwise(F.col("prompt")).alias("prompt"),
                F.coalesce("response", "last_response").alias("last_response"),
            )
        )
        if open_rows.isEmpty():
            break
    log.append(
        open_rows.where("last_response IS NOT NULL").select(
            *keys,
            F.lit(max_calls - 1).alias("attempt"),
            F.lit("exhausted").alias("parse_error"),
            F.length("last_response").alias("response_chars"),
            F.col("last_response").alias("response"),
        )
    )

    def together(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    return together(accepted), together(log), open_rows.select(*keys, "last_response")


def log_to_keep(log: DataFrame, only_failures: bool = True) -> DataFrame:
    """Failures always; successes only for an audit."""
    return log.where("parse_error IS NOT NULL") if only_failures else log
