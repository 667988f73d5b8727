"""Token counts as an exact histogram of encoded lengths.

Documents are encoded once, where they are; each task sends one row per length. Suffix
sums over the lengths then answer, for every context limit, how many documents and
tokens are in reach, what is left when documents are truncated to the limit, and which
length a quantile has.

Defined results: null and empty texts have length 0; very long texts, long runs of one
character included, are encoded whole; repeated rows count each; ties are
one row; an empty table gives an empty histogram, whose totals are 0.
"""

from __future__ import annotations

import base64
import re
import sys
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import common

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 1024
# Runs of white space from here on are cut out before the pattern sees them: it steps back
# through a run character by character.
_LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


def encoder(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ordinary(encoding, text: str) -> list[int]:
    """Ids of a text, with runs of white space of any length.

    A run is one piece, up to its last character when something follows: that one the pattern
    keeps for the next piece. No piece reaches into a run from before it.
    """
    ids, at = [], 0
    for run in _LONG_RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        ids += encoding.encode_ordinary(text[at : run.start()])
        ids += encoding._encode_single_piece(text[run.start() : end])
        at = end
    return (ids + encoding.encode_ordinary(text[at:])) if at else encoding.encode_ordinary(text)


def histogram(docs: DataFrame, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """(n_tokens, n_docs). The driver reads the vocabulary, a file of fixed size, and sends it."""
    with open(vocabulary_path, "rb") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(sent.value)
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts[len(ordinary(encoding, text.as_py() or ""))] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())],
            names=["n_tokens", "n_docs"],
        )

    lengths = docs.select(F.col("text").cast("string")).mapInArrow(run, "n_tokens long, n_docs long")
    return lengths.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(lengths: DataFrame) -> DataFrame:
    """Per length L of the histogram: documents and tokens at or above it, documents at or
    below it, and all tokens when every document is truncated to L.

    Lengths are summed in blocks of ``BLOCK``, and the few block totals along the blocks.
    """
    lengths = lengths.withColumns(
        {"tokens": F.col("n_tokens") * F.col("n_docs"), "__llm_block": F.floor(F.col("n_tokens") / BLOCK)}
    )
    blocks = lengths.groupBy("__llm_block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.desc("__llm_block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "__llm_block",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"),
        F.sum("d").over(everything).alias("d_all"),
        F.sum("t").over(everything).alias("t_all"),
    )
    inside = Window.partitionBy("__llm_block").orderBy(F.desc("n_tokens"))
    df = lengths.join(blocks, "__llm_block").withColumns(
        {
            "docs_from": F.col("d_after") + F.sum("n_docs").over(inside),
            "tokens_from": F.col("t_after") + F.sum("tokens").over(inside),
        }
    )
    return df.select(
        "n_tokens", "n_docs", "docs_from", "tokens_from",
        (F.col("d_all") - F.col("docs_from") + F.col("n_docs")).alias("docs_to"),
        (F.col("t_all") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated_total"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Per context limit: documents longer than it, and all tokens truncated to it.

    Between two lengths of the histogram the truncated total grows by the number of
    longer documents per token.
    """
    wanted = sums.sparkSession.createDataFrame([(n,) for n in limits], "context long")
    longer = F.col("n_tokens") > F.col("context")
    return (
        sums.join(F.broadcast(wanted))
        .groupBy("context")
        .agg(
            F.coalesce(F.max(F.when(longer, F.col("docs_from"))), F.lit(0)).alias("longer"),
            F.coalesce(F.max(F.when(~longer, F.struct("n_tokens", "truncated_total")))["truncated_total"], F.lit(0)).alias("base"),
            F.coalesce(F.max(F.when(~longer, F.col("n_tokens"))), F.lit(0)).alias("reached"),
        )
        .select(
            "context", "longer",
            (F.col("base") + (F.col("context") - F.col("reached")) * F.col("longer")).alias("truncated_total"),
        )
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """Per share, the smallest length that at least so many of the documents do not exceed."""
    wanted = sums.sparkSession.createDataFrame([(q,) for q in shares], "share double")
    total = sums.agg(F.max("docs_to").alias("total"))
    return (
        sums.join(F.broadcast(total)).join(F.broadcast(wanted))
        .where(F.col("docs_to") >= F.col("share") * F.col("total"))
        .groupBy("share")
        .agg(F.min("n_tokens").alias("n_tokens"))
    )


def op9(spark, sf) -> DataFrame:
    return suffix_sums(common.stage(histogram(common.documents(spark, sf)), "lengths"))


# Functions of this module travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
