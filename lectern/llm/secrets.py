"""Secret scan: base patterns plus the entropy of sliding windows.

Candidate strings are runs of token characters that are not plain words. A window
of ``window`` characters slides over each; the Shannon entropy of the window is kept
up to date from the counts of the two characters that enter and leave. Windows at
or above the threshold of the string's character class mark the span from the
first to the last of them. Allow-listed strings and strings that touch a base
span add nothing.

Defined results: null and empty texts give no spans; equal rows give equal
spans; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import common

# The base patterns.
PATTERNS = {
    "assign": (
        r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
    ),
    "access": r"AKIA[A-Z0-9]{12,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{32,}+",
}
ASSIGN_VALUE = r"""^(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
KINDS = [*PATTERNS, "entropy"]

_CHAR = "[A-Za-z0-9+/=_-]"


@dataclass(frozen=True)
class Rules:
    """Bits per window from which a class counts as random, and what is let through."""

    window: int = 20
    bits: dict[str, float] = field(
        default_factory=lambda: {"hex": 3.0, "letters": 3.8, "alnum": 3.6, "base64": 3.6}
    )
    allow: tuple[str, ...] = (
        r"^[0-9+/=_-]+$",
        r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
        r"^[A-Za-z]?[a-z]*([-_/+=][A-Za-z]?[a-z]*)*$",
        r"(?i)example|placeholder|changeme|your[-_]",
        r"(?i)0123456789|abcdefghij",
    )


def _entropy(window: int) -> str:
    """SQL: best window entropy of ``chars`` and the reach of the windows at or above ``bits``.

    ``core`` holds the characters shared by the old and the new window. With n of
    them equal to a leaving or entering one, the sum of c * log2(c) changes by the
    difference between n + 1 and n.
    """

    def change(char: str) -> str:
        n = f"size(filter(core, y -> y = {char}))"
        return f"transform(array({n}), n -> (n + 1) * log2(n + 1) - CASE WHEN n = 0 THEN 0D ELSE n * log2(n) END)[0]"

    step = f"""transform(array(slice(chars, greatest(i - {window} + 1, 1), least(i - 1, {window} - 1))), core ->
        {change('chars[i - 1]')}
        - CASE WHEN i > {window} THEN {change(f'chars[i - {window} - 1]')} ELSE 0D END)[0]"""
    return f"""aggregate(sequence(1, size(chars)),
        named_struct('sum', 0D, 'best', 0D, 'first', -1, 'last', -1),
        (acc, i) -> transform(array(acc.sum + {step}), total ->
          transform(array(CASE WHEN i >= {window} THEN log2({window}) - total / {window} ELSE 0D END), h ->
            named_struct('sum', total, 'best', greatest(acc.best, h),
              'first', CASE WHEN h >= bits AND acc.first < 0 THEN i - {window} ELSE acc.first END,
              'last', CASE WHEN h >= bits THEN i ELSE acc.last END))[0])[0])"""


def scan(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Add ``secrets``: array of ``struct<start, rank, end, kind, text>``, sorted by place."""
    rules = rules or Rules()
    # A candidate is a whole run that has a digit or a lower-to-upper change.
    candidate = rf"(?<!{_CHAR})(?={_CHAR}*?(?:[0-9]|[a-z][A-Z])){_CHAR}{{{rules.window},}}+"
    df = docs.withColumn("__llm_text", common.text_of(docs))
    df = common.with_spans(df, "__llm_text", {**PATTERNS, "entropy": candidate})
    df = df.withColumn(
        "__llm_assign",
        F.filter("__llm_assign", lambda s: F.length(F.regexp_extract(s["text"], ASSIGN_VALUE, 1)) >= 8),
    )
    base = F.concat(*[common.labelled(f"__llm_{k}", k, r) for r, k in enumerate(PATTERNS)])
    df = df.withColumn("__llm_base", F.array_sort(base))
    allowed = " OR ".join(f"s.text RLIKE '{p}'" for p in rules.allow)
    bits = rules.bits
    df = df.withColumn(
        "__llm_entropy",
        F.expr(
            f"""filter(transform(
              filter(__llm_entropy, s -> NOT ({allowed})
                AND NOT exists(__llm_base, b -> b.start < s.end AND s.start < b.end)),
              s -> transform(array(struct(split(s.text, '') AS chars,
                     CASE WHEN s.text RLIKE '^([0-9a-f]+|[0-9A-F]+)$' THEN {bits['hex']}D
                          WHEN s.text RLIKE '^[A-Za-z]+$' THEN {bits['letters']}D
                          WHEN s.text RLIKE '^[A-Za-z0-9]+$' THEN {bits['alnum']}D
                          ELSE {bits['base64']}D END AS bits)),
                c -> transform(array({_entropy(rules.window).replace('chars', 'c.chars').replace('bits', 'c.bits')}),
                  w -> named_struct('start', s.start + w.first, 'end', s.start + w.last,
                         'text', CASE WHEN w.first < 0 THEN '' ELSE
                           substring(s.text, w.first + 1, w.last - w.first) END))[0])[0]),
              s -> s.text <> '')"""
        ),
    )
    entropy = common.labelled("__llm_entropy", "entropy", len(PATTERNS))
    df = df.withColumn("secrets", F.array_sort(F.concat(F.col("__llm_base"), entropy)))
    return df.drop("__llm_text", "__llm_base", *[f"__llm_{k}" for k in KINDS])


def redact(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The documents with every secret in ``text`` replaced by its kind; null texts stay null."""
    df = scan(common.packed(docs, "text"), rules)
    df = df.withColumn("text", common.redacted("text", "secrets"))
    return common.unpacked(df, docs.columns, text="text")


def op5(spark, sf) -> DataFrame:
    df = scan(common.documents(spark, sf).select("doc_id", "text")).drop("text")
    df = df.withColumn("__llm_base", F.filter("secrets", lambda s: s["kind"] != "entropy"))
    return df.select(
        "doc_id",
        *[common.kind_count("__llm_base", k).alias(f"n_{k}") for k in PATTERNS],
        F.sha2(common.span_list("__llm_base"), 256).alias("base_sha256"),
        common.span_list("secrets").alias("spans"),
    )
