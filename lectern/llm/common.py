"""Helpers shared by the corpus operators: words, spans, staged tables.

Column rule of all operators: working columns start with ``__llm_``; an output
column replaces an input column of the same name, every other input column is
passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import scratch_path

SPACE = r"[ \t-\r]+"
SPACE_CHARS = " \t\n\x0b\f\r"

_FOLD = 256


def documents(spark: SparkSession, sf: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """The text, empty when null."""
    return F.coalesce(docs[column].cast("string"), F.lit(""))


def packed(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns beside the whole row, so that working columns clash with none of it."""
    return docs.select(F.struct(*docs.columns).alias("__llm_doc"), *columns)


def unpacked(df: DataFrame, columns: list[str], **replaced: str) -> DataFrame:
    """The columns of ``packed`` rows again, some of them replaced by others."""
    return df.select(
        *[F.col(replaced[c]).alias(c) if c in replaced else F.col("__llm_doc")[c].alias(c) for c in columns]
    )


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; empty array for none."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^ \t-\r]++")).cast("long")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    Cuts the lineage: a lost executor repeats nothing before this point.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def running_sums(lengths: str) -> str:
    """SQL for the inclusive running sums of an int array.

    Folded in blocks, so that the array copies of the fold stay short however
    long the array is.
    """
    fold = (
        "aggregate({0}, CAST(array() AS array<int>),"
        " (acc, x) -> concat(acc, array(coalesce(try_element_at(acc, -1), 0) + x)))"
    )
    inside = f"transform(sequence(0, (size({lengths}) - 1) div {_FOLD}), b -> " + fold.format(
        f"slice({lengths}, b * {_FOLD} + 1, {_FOLD})"
    ) + ")"
    single = fold.format(lengths)
    offsets = (
        f"aggregate({inside}, named_struct('base', 0, 'out', CAST(array() AS array<array<int>>)),"
        " (acc, part) -> named_struct('base', acc.base + element_at(part, -1),"
        " 'out', concat(acc.out, array(transform(part, v -> v + acc.base)))), acc -> flatten(acc.out))"
    )
    return (
        f"CASE WHEN size({lengths}) = 0 THEN CAST(array() AS array<int>)"
        f" WHEN size({lengths}) <= {_FOLD} THEN {single} ELSE {offsets} END"
    )


def with_spans(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Add, per entry of ``patterns``, the array column ``__llm_<name>`` of its matches.

    Elements are ``struct<start, end, text>``: leftmost non-overlapping matches,
    positions in code points, end exclusive. The parts between the matches give the
    positions, so no match is searched twice.
    """
    df = df.withColumns(
        {f"__llm_hit_{n}": F.regexp_extract_all(text, F.lit(p), F.lit(0)) for n, p in patterns.items()}
    )
    df = df.withColumns(
        {
            f"__llm_step_{n}": F.when(
                F.size(f"__llm_hit_{n}") > 0,
                F.zip_with(
                    F.slice(F.split(text, p, -1), 1, F.size(f"__llm_hit_{n}")),
                    F.col(f"__llm_hit_{n}"),
                    lambda gap, hit: F.length(gap) + F.length(hit),
                ),
            ).otherwise(F.array().cast("array<int>"))
            for n, p in patterns.items()
        }
    )
    df = df.withColumns({f"__llm_end_{n}": F.expr(running_sums(f"__llm_step_{n}")) for n in patterns})
    df = df.withColumns(
        {
            f"__llm_{n}": F.zip_with(
                f"__llm_hit_{n}",
                f"__llm_end_{n}",
                lambda hit, end: F.struct(
                    (end - F.length(hit)).alias("start"), end.alias("end"), hit.alias("text")
                ),
            )
            for n in patterns
        }
    )
    return df.drop(*[f"__llm_{part}_{n}" for n in patterns for part in ("hit", "step", "end")])


def labelled(spans: str, kind: str, rank: int) -> Column:
    """Spans of one kind as ``struct<start, rank, end, kind, text>``, which sorts by place."""
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"),
            F.lit(kind).alias("kind"), s["text"].alias("text"),
        ),
    )


def kind_count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def span_list(spans: str) -> Column:
    """``kind:start:end`` of all spans, joined by commas in their order."""
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


def redacted(text: str, spans: str) -> Column:
    """The text with every span replaced by ``[KIND]``; overlapping spans become one.

    Spans of the kind ``removed`` leave nothing. ``spans`` is sorted by start. The fold first joins overlapping spans (the label
    of the first one stays), then the pieces between them are put together.
    """
    return F.expr(
        f"""CASE WHEN size({spans}) = 0 THEN {text} ELSE
        concat(array_join(transform(
          aggregate({spans},
            named_struct('done', CAST(array() AS array<struct<a:int,s:int,e:int,k:string>>),
                         'a', 0, 's', {spans}[0].start, 'e', {spans}[0].end, 'k', {spans}[0].kind),
            (acc, x) -> CASE WHEN x.start < acc.e OR x.start = acc.s
              THEN named_struct('done', acc.done, 'a', acc.a, 's', acc.s, 'e', greatest(acc.e, x.end), 'k', acc.k)
              ELSE named_struct('done', concat(acc.done, array(named_struct('a', acc.a, 's', acc.s, 'e', acc.e, 'k', acc.k))),
                                'a', acc.e, 's', x.start, 'e', x.end, 'k', x.kind) END,
            acc -> concat(acc.done, array(named_struct('a', acc.a, 's', acc.s, 'e', acc.e, 'k', acc.k)))),
          p -> concat(substring({text}, p.a + 1, p.s - p.a), CASE WHEN p.k = 'removed' THEN '' ELSE concat('[', upper(p.k), ']') END)), ''),
          substring({text}, array_max(transform({spans}, x -> x.end)) + 1)) END"""
    )
