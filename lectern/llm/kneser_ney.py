"""Quality classifier: interpolated modified Kneser-Ney models over words, per language.

Trusted documents (labelled good and not toxic) are all counted, in two halves by the hash
of their text. A document is scored by the model of the half that does not hold its text:
no document, and no copy of it, meets its own counts, so thresholds from trusted documents
hold for others. The word models (``word_shards``) are counts in shards that grow with the
trusted text; documents stay where they are read, and their distinct trigrams go to the
shards and come back as counts. Words that a model has not seen are spelled by a character
model of the same half.

Characters are folded to ``V`` symbols there, so an n-gram is one integer below V ** ORDER;
characters that share a symbol are taken as equally likely. Lower orders count the
distinct n-grams that end in them; every order is joined with the totals of its contexts.
The spelling tables have at most V ** ORDER entries of four bytes (23 MB for each half), whatever
the input, and are sent to the tasks; contexts never seen share the rows of the lower order.

Perplexity is by character. Quantiles of a language's trusted documents of about the same
length set two thresholds: text that is too easy to guess (repeated words, lists) is as odd
as text that surprises. A length with few trusted documents takes the language's quantiles.

Defined results: null and empty texts and those of white space only have no perplexity and
are not kept; documents of a null language, or of one without trusted documents, have no
threshold and are kept; repeated ids in the labels count as trusted when any row is; ties
with a threshold are kept; without trusted documents every document with a text is kept;
equal rows get equal verdicts; an empty table gives an empty table.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import common, word_shards
from lectern.llm.word_scan import give_back
from lectern.llm.word_shards import summed

ORDER = 4
# The symbols. Letters without an own symbol share one, and so do marks.
ALPHABET = " abcdefghijklmnopqrstuvwxyz0.,'-éèêàçñóíáúüöäß"
SYMBOLS = {char: i for i, char in enumerate(ALPHABET)}
LETTER, OTHER, BORDER = len(SYMBOLS), len(SYMBOLS) + 1, len(SYMBOLS) + 2
V = len(SYMBOLS) + 3


@dataclass(frozen=True)
class Settings:
    """Quantiles of the thresholds, and when a length class has its own."""

    low: float = 0.01
    high: float = 0.99
    class_documents: int = 200


def _symbol_table() -> np.ndarray:
    table = np.full(0x10000, OTHER, dtype=np.int32)
    for code in range(0x10000):
        char = chr(code)
        low = char.lower() if len(char.lower()) == 1 else char
        if low in SYMBOLS:
            table[code] = SYMBOLS[low]
        elif char.isspace():
            table[code] = SYMBOLS[" "]
        elif char.isdigit():
            table[code] = SYMBOLS["0"]
        elif char.isalpha():
            table[code] = LETTER
    return table


def grams(text: str, table: np.ndarray) -> np.ndarray:
    """All n-grams of a text that starts after a border."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    symbols = np.full(len(codes) + ORDER - 1, BORDER, dtype=np.int32)
    symbols[ORDER - 1 :] = table[np.minimum(codes, 0xFFFF)]
    value = np.zeros(len(codes), dtype=np.int32)
    for k in range(ORDER):
        value = value * V + symbols[k : k + len(codes)]
    return value


#: n-grams gathered before they are counted.
_CHUNK = 4_000_000


def count_grams(docs: DataFrame) -> DataFrame:
    """(half, gram, n) over all given documents; a task sends each of its n-grams once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _symbol_table()
        held, counts, size = ([], []), ([], []), 0

        def settle():
            for parts, found in zip(held, counts):
                if parts:
                    found.append(np.unique(np.concatenate(parts), return_counts=True))
                    found[:] = [summed(found)]
                    parts.clear()

        for batch in batches:
            for half, text in zip(*batch.columns):
                got = grams(text.as_py() or "", table)
                held[half.as_py()].append(got)
                size += len(got)
                if size > _CHUNK:
                    settle()
                    size = 0
        settle()
        for half, found in enumerate(counts):
            for gram, n in found:
                for at in range(0, len(gram), 100_000):
                    columns = [x[at : at + 100_000].astype(np.int64) for x in (gram, n)]
                    columns = [pa.array(np.full(len(columns[0]), half, np.int32)), *map(pa.array, columns)]
                    yield pa.RecordBatch.from_arrays(columns, names=["half", "gram", "n"])
        give_back()

    counted = docs.select("half", F.col("text").cast("string")).mapInArrow(run, "half int, gram long, n long")
    return counted.groupBy("half", "gram").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> list[float]:
    """The three discounts of an order, from its counts of counts."""
    row = counts.agg(*[F.count(F.when(F.col("n") == k, 1)).alias(f"c{k}") for k in (1, 2, 3, 4)]).first()
    c = [row[f"c{k}"] for k in (1, 2, 3, 4)]
    y = c[0] / (c[0] + 2 * c[1]) if c[0] else 0.0
    raw = [k - (k + 1) * y * c[k] / c[k - 1] if c[k - 1] else 0.5 * k for k in (1, 2, 3)]
    return [min(max(d, 0.05), k - 0.05) for d, k in zip(raw, (1, 2, 3))]


def weights(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of one order: (gram, share) after discounting, and (context, rest) for the lower order."""
    d1, d2, d3 = discounts(counts)
    held = counts.withColumns(
        {
            "context": F.floor(F.col("gram") / V),
            "taken": F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3),
        }
    )
    contexts = held.groupBy("context").agg(F.sum("n").alias("total"), F.sum("taken").alias("taken_all"))
    shares = held.join(contexts, "context").select("gram", ((F.col("n") - F.col("taken")) / F.col("total")).alias("share"))
    return shares, contexts.select("context", (F.col("taken_all") / F.col("total")).alias("rest"))


def train(docs: DataFrame) -> np.ndarray:
    """The logarithm of the probability of every n-gram's last symbol after the others."""
    return logs_of(common.stage(count_grams(docs.withColumn("half", F.lit(0))), "grams"))


def logs_of(counts: DataFrame) -> np.ndarray:
    """The same from (gram, n)."""
    orders = [counts.select("gram", "n")]
    for order in range(ORDER - 1, 0, -1):
        lower = orders[0].select((F.col("gram") % V**order).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
        orders.insert(0, common.stage(lower, "grams"))
    probability = np.full(V, 1.0 / V)
    for order, counted in enumerate(orders, 1):
        shares, contexts = weights(counted)
        # At most V ** order rows: the bound of the table.
        gram, share = _columns(shares, "gram", "share")
        context, rest = _columns(contexts, "context", "rest")
        lower = np.ones(V ** (order - 1))
        lower[context] = rest
        probability = np.tile(probability, V if order > 1 else 1)
        probability.reshape(-1, V)[:] *= lower[:, None]
        probability[gram] += share
    return np.log(probability, out=probability).astype(np.float32)


def _columns(df: DataFrame, key: str, value: str) -> tuple[np.ndarray, np.ndarray]:
    table = df.select(key, value).toArrow()
    return table[key].to_numpy().astype(np.int64), table[value].to_numpy()


#: Characters that share a symbol, about.
SHARED = {LETTER: 130_000, OTHER: 10_000, SYMBOLS["0"]: 10}


def compact(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A table's different rows, and the row of each context: contexts never seen have the row of the lower order."""
    rows: dict[bytes, int] = {}
    at = np.array([rows.setdefault(row.tobytes(), len(rows)) for row in table.reshape(-1, V)], np.int32)
    return np.frombuffer(b"".join(rows), table.dtype).reshape(-1, V), at


#: Words spelled at a time.
_SPELLED = 20_000


def spellers(tables: list[tuple[np.ndarray, np.ndarray]]) -> list:
    """Per half, from ``compact``, the logarithms of the probabilities of words' letters and ends."""
    symbols = _symbol_table()
    alike = np.zeros(V)
    for symbol, n in SHARED.items():
        alike[symbol] = -np.log(n)

    def speller(rows: np.ndarray, row_of: np.ndarray):
        def spell(words: list[str]) -> np.ndarray:
            return np.concatenate([np.zeros(0), *[some(words[at : at + _SPELLED]) for at in range(0, len(words), _SPELLED)]])

        def some(words: list[str]) -> np.ndarray:
            # Each word stands between spaces, the first of them after a border.
            sizes = np.array([len(w) for w in words], np.int64)
            ends = np.cumsum(sizes + ORDER)
            starts = ends - sizes - ORDER
            codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            said = np.full(len(codes) + ORDER * len(words), BORDER, np.int32)
            said[starts + ORDER - 2] = said[ends - 1] = SYMBOLS[" "]
            letters = np.ones(len(said), bool)
            letters[(starts[:, None] + np.arange(ORDER - 1)).ravel()] = letters[ends - 1] = False
            said[letters] = symbols[np.minimum(codes, 0xFFFF)]
            context = np.zeros(len(said), np.int32)
            for k in range(ORDER - 1):
                context[ORDER - 1 :] = context[ORDER - 1 :] * V + said[k : len(said) - ORDER + 1 + k]
            logs = rows[row_of[context], said] + np.where(letters, alike[said], 0.0)
            logs[(starts[:, None] + np.arange(ORDER - 1)).ravel()] = 0.0
            return np.add.reduceat(logs, starts)

        return spell

    return [speller(*table) for table in tables]


def score(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, ``lang``, number of characters, perplexity by the other half."""
    part = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        F.col("text").cast("string").alias("text"),
    ).withColumns({"half": F.pmod(part, F.lit(2)).cast("int"), "part": F.pmod(F.shiftright(part, 1), F.lit(1 << 30))})
    rows = rows.join(trusted.withColumn("good", F.lit(1)), "doc_id", "left").withColumn("good", F.coalesce("good", F.lit(0)))
    good = rows.where("good = 1")
    counts = common.stage(count_grams(good), "grams")
    sent = docs.sparkSession.sparkContext.broadcast([compact(logs_of(counts.where(F.col("half") == half))) for half in (0, 1)])
    return word_shards.score(rows, lambda: spellers(sent.value))


#: Trusted ids (8 bytes each) up to which they are sent to all executors.
BROADCAST_ROWS = 1_000_000


def classify(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Per row: ``perplexity``, ``lowest`` and ``threshold`` (null without one) and ``kept``."""
    settings = settings or Settings()
    trusted = common.stage(
        labels.where("quality = 1 AND toxic = 0").select(F.col("doc_id").cast("long").alias("doc_id"))
        .where("doc_id IS NOT NULL").distinct(),
        "trusted",
    )
    if trusted.count() <= BROADCAST_ROWS:
        trusted = F.broadcast(trusted)
    scored = common.stage(score(docs, trusted), "perplexity").withColumn(
        "__llm_class", F.length(F.bin("n_symbols"))
    )
    good = scored.join(trusted, "doc_id", "left_semi").where("perplexity IS NOT NULL AND lang IS NOT NULL")
    bounds = [
        F.percentile_approx("perplexity", F.lit(q), F.lit(10_000)).alias(name)
        for name, q in (("low", settings.low), ("high", settings.high))
    ]
    by_class = good.groupBy("lang", "__llm_class").agg(F.struct(*bounds).alias("__llm_own"), F.count("*").alias("n"))
    by_class = by_class.where(F.col("n") >= settings.class_documents).drop("n")
    by_lang = good.groupBy("lang").agg(F.struct(*bounds).alias("__llm_all"))
    bound = F.coalesce("__llm_own", "__llm_all")
    inside = F.col("perplexity").between(F.col("lowest"), F.col("threshold"))
    return (
        scored.join(by_class, ["lang", "__llm_class"], "left")
        .join(by_lang, "lang", "left")
        .withColumns({"lowest": bound["low"], "threshold": bound["high"]})
        .withColumn("kept", F.col("perplexity").isNotNull() & (F.col("threshold").isNull() | inside))
        .select("doc_id", "lang", "n_symbols", "perplexity", "lowest", "threshold", "kept")
    )


def op10(spark, sf) -> DataFrame:
    return classify(common.documents(spark, sf), common.documents(spark, sf, "labels"))


# Functions of this module travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
