"""Quality rules: base counts, and the divergence of histograms from language references.

Each document gives two histograms: characters by class, and words by a list of
common words plus one bin for all others. The reference of a language is the mean
of the normalised histograms of its documents that pass the base rules, over the
whole input. A document fails when the Jensen-Shannon divergence (base 2, 0 to 1)
of a histogram from the reference of its language exceeds a limit and the document
is long enough for that histogram to mean something. The limit for words is the sampling
noise of the histogram itself, as the documents of that language and length show it.

Defined results: null and empty texts have no words and fail; documents of an
unlisted or null language are judged by the base rules only; equal rows get equal
verdicts; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import common

# Common words by language.
COMMON = {
    "de": "der die und das ist nicht mit den von ein",
    "en": "the of and to a in is that it for",
    "es": "el la los de que y en un por con",
    "fr": "le la les de et un une est que pour",
}
WORDS = sorted({w for text in COMMON.values() for w in text.split()})
LANGUAGES = sorted(COMMON)

# Characters of a class, as what is left after removing all others.
CLASSES = {
    "lower": r"[^a-z]+",
    "upper": r"[^A-Z]+",
    "digit": r"[^0-9]+",
    "symbol": r"[^#*$%&|<>=@\\^_~/+{}\[\]]+",
    "stop": r"[^.,;:!?'\"()-]+",
    "beyond": r"[\x00-\x7F]+",
}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


@dataclass(frozen=True)
class Limits:
    """Divergence limits and the sizes from which each histogram is judged.

    A histogram of n words lies about c / n from its own source by chance alone. The
    documents that pass the base rules give c and its spread, by language and by octave of
    n: ``spread`` standard deviations above the median are allowed. A class of fewer than
    ``class_documents`` takes those of its language.
    """

    chars: float = 0.12
    spread: float = 4.0
    class_documents: int = 50
    min_chars: int = 250
    min_words: int = 50


def _repeat_words(words: str, grams: str) -> str:
    """SQL: words inside 3-word windows that occur more than once.

    The sort is reached only when some window repeats.
    """
    order = f"sort_array(transform({grams}, (g, i) -> struct(g AS g, i AS i)))"
    return f"""CASE WHEN size({grams}) = size(array_distinct({grams})) THEN 0L ELSE
      CAST(size(array_distinct(flatten(transform(array({order}), s ->
        flatten(transform(
          filter(sequence(0, size(s) - 1), j -> (j > 0 AND s[greatest(j - 1, 0)].g = s[j].g)
            OR (j < size(s) - 1 AND s[least(j + 1, size(s) - 1)].g = s[j].g)),
          j -> array(s[j].i, s[j].i + 1, s[j].i + 2))))))) AS BIGINT) END"""


def features(docs: DataFrame) -> DataFrame:
    """Add the base counts, ``base_failed``, and the arrays ``__llm_chars`` and ``__llm_common``."""
    df = docs.withColumn("__llm_text", common.text_of(docs))
    df = df.withColumn("__llm_words", common.words(F.col("__llm_text")))
    listed = ", ".join(f"'{w}'" for w in WORDS)
    df = df.withColumns(
        {
            "n_words": F.size("__llm_words").cast("long"),
            "word_chars": F.length(F.regexp_replace("__llm_text", common.SPACE, "")).cast("long"),
            "n_symbols": (
                F.length("__llm_text") - F.length(F.translate("__llm_text", "#*$%&|<>", ""))
            ).cast("long"),
            "__llm_lines": F.when(
                F.contains(F.col("__llm_text"), F.lit("\n")),
                F.filter(
                    F.split("__llm_text", "\n"), lambda line: F.btrim(line, F.lit(common.SPACE_CHARS)) != ""
                ),
            ).otherwise(F.array().cast("array<string>")),
            "__llm_grams": F.expr(
                "CASE WHEN size(__llm_words) < 3 THEN CAST(array() AS array<bigint>) ELSE "
                "transform(slice(__llm_words, 1, size(__llm_words) - 2),"
                " (w, i) -> xxhash64(w, __llm_words[i + 1], __llm_words[i + 2])) END"
            ),
            "__llm_hits": F.expr(f"concat('|', array_join(filter(__llm_words, w -> w IN ({listed})), '||'), '|')"),
            **{
                f"__llm_class_{name}": F.length(F.regexp_replace("__llm_text", other, ""))
                for name, other in CLASSES.items()
            },
        }
    )
    df = df.withColumns(
        {
            "n_dup_lines": (F.size("__llm_lines") - F.size(F.array_distinct("__llm_lines"))).cast("long"),
            "n_repeat_words": F.expr(_repeat_words("__llm_words", "__llm_grams")),
            "__llm_chars": F.array(*[F.col(f"__llm_class_{name}").cast("double") for name in CLASSES]),
            "__llm_common": F.array(
                *[
                    (
                        (F.length("__llm_hits") - F.length(F.replace("__llm_hits", F.lit(f"|{w}|"), F.lit(""))))
                        / (len(w) + 2)
                    ).cast("double")
                    for w in WORDS
                ]
            ),
        }
    )
    df = df.withColumns(
        {
            "base_failed": (F.col("n_words") < 50)
            | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50),
            "__llm_common": F.expr(
                "concat(__llm_common, array(n_words - aggregate(__llm_common, 0D, (a, x) -> a + x)))"
            ),
        }
    )
    return df.drop(
        "__llm_text", "__llm_words", "__llm_lines", "__llm_grams", "__llm_hits",
        *[f"__llm_class_{name}" for name in CLASSES],
    )


def _shares(counts: str) -> Column:
    return F.expr(
        f"transform(array(aggregate({counts}, 0D, (a, x) -> a + x)),"
        f" t -> transform({counts}, x -> CASE WHEN t = 0 THEN 0D ELSE x / t END))[0]"
    )


def references(scored: DataFrame) -> DataFrame:
    """Per listed language, the mean histograms of the documents that pass the base rules."""
    sizes = {"chars": len(CLASSES), "common": len(WORDS) + 1}
    shares = scored.where(~F.col("base_failed") & F.col("lang").isin(LANGUAGES)).select(
        F.col("lang").cast("string").alias("__llm_lang"),
        *[_shares(f"__llm_{name}").alias(name) for name in sizes],
    )
    means = shares.groupBy("__llm_lang").agg(
        *[F.avg(F.col(name)[i]).alias(f"{name}_{i}") for name, n in sizes.items() for i in range(n)]
    )
    return means.select(
        "__llm_lang",
        *[F.array(*[F.col(f"{name}_{i}") for i in range(n)]).alias(f"__llm_ref_{name}") for name, n in sizes.items()],
    )


def divergence(p: str, q: str) -> str:
    """SQL: Jensen-Shannon divergence of two arrays of shares, base 2."""
    return (
        f"aggregate(zip_with({p}, {q}, (a, b) ->"
        " (CASE WHEN a > 0 THEN a * log2(2 * a / (a + b)) ELSE 0D END"
        " + CASE WHEN b > 0 THEN b * log2(2 * b / (a + b)) ELSE 0D END) / 2), 0D, (s, x) -> s + x)"
    )


_OCTAVE = "length(bin(n_words))"


def rooms(df: DataFrame) -> DataFrame:
    """Per language and octave of words (0: all): median and standard deviation of words x ``js_words``.

    Quartiles, so that odd documents do not widen their own limit, and equal documents count
    once, so that copies do not narrow the limit of all others. The divergence of k free
    bins follows chi-square / (8 ln 2 n), which gives the least deviation for a median.
    """
    once = df.where(~F.col("base_failed") & F.col("js_words").isNotNull()).select(
        F.col("lang").cast("string").alias("__llm_lang"), "n_words", "js_words"
    ).distinct()
    noise = once.select(
        "__llm_lang",
        F.explode(F.array(F.expr(_OCTAVE), F.lit(0))).alias("__llm_octave"),
        (F.col("n_words") * F.col("js_words")).alias("noise"),
    )
    quartiles = noise.groupBy("__llm_lang", "__llm_octave").agg(
        F.percentile_approx("noise", [0.5, 0.75], 10_000).alias("q"), F.count("*").alias("n")
    )
    median = F.greatest(F.col("q")[0], F.lit(1.0))
    return quartiles.select(
        "__llm_lang", "__llm_octave", "n", median.alias("median"),
        F.greatest((F.col("q")[1] - F.col("q")[0]) / 0.6745, F.sqrt(2 * median / (8 * math.log(2)))).alias("deviation"),
    )


def judge(scored: DataFrame, reference: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Add ``js_chars``, ``js_words`` (null without a reference) and ``kept``.

    The reference has one row per listed language at most, and the rooms one per octave of
    those, which bounds the broadcasts. An octave never gets less room than its language.
    """
    limits = limits or Limits()
    df = scored.withColumns({f"__llm_share_{n}": _shares(f"__llm_{n}") for n in ("chars", "common")})
    df = df.join(F.broadcast(reference), F.col("lang") == F.col("__llm_lang"), "left")
    df = df.withColumns(
        {
            "js_chars": F.expr(divergence("__llm_share_chars", "__llm_ref_chars")),
            "js_words": F.expr(divergence("__llm_share_common", "__llm_ref_common")),
        }
    )
    room = common.stage(rooms(df), "rooms")
    own = room.where((F.col("__llm_octave") > 0) & (F.col("n") >= limits.class_documents))
    for name, part, on in (
        ("own", own, (F.col("lang") == F.col("__llm_l")) & (F.col("__llm_o") == F.expr(_OCTAVE))),
        ("all", room.where("__llm_octave = 0"), F.col("lang") == F.col("__llm_l")),
    ):
        part = part.select(
            F.col("__llm_lang").alias("__llm_l"), F.col("__llm_octave").alias("__llm_o"),
            (F.col("median") + limits.spread * F.col("deviation")).alias(f"__llm_room_{name}"),
        )
        df = df.join(F.broadcast(part), on, "left").drop("__llm_l", "__llm_o")
    limit = F.greatest("__llm_room_own", "__llm_room_all") / F.col("n_words")
    odd = [
        (F.col("word_chars") >= limits.min_chars) & (F.coalesce("js_chars", F.lit(0.0)) > limits.chars),
        (F.col("n_words") >= limits.min_words) & F.coalesce(F.col("js_words") > limit, F.lit(False)),
    ]
    return df.withColumn("kept", ~F.col("base_failed") & ~reduce(Column.__or__, odd)).drop(
        "__llm_lang", "__llm_room_own", "__llm_room_all", *[f"__llm_{part}{n}" for n in ("chars", "common") for part in ("", "share_", "ref_")]
    )


def assess(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Documents with base counts, divergences and ``kept``.

    The counts are written once, with the rows: the references and the verdicts both
    read them.
    """
    scored = common.stage(features(docs), "quality")
    return judge(scored, references(scored), limits)


def select(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """The documents that pass, with their own columns."""
    scored = common.stage(features(common.packed(docs, "text", "lang")).drop("text"), "quality")
    return common.unpacked(judge(scored, references(scored), limits).where("kept"), docs.columns)


def op7(spark, sf) -> DataFrame:
    docs = common.documents(spark, sf).select("doc_id", "lang", "text")
    scored = common.stage(features(docs).drop("text"), "quality")
    return judge(scored, references(scored)).select("doc_id", *BASE, "kept", "js_chars", "js_words")
