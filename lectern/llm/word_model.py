"""Modified Kneser-Ney model over words, one per language and half, held as tables.

A word is a run of letters and digits; a character of a script written without spaces and
a mark are words too. A word is known by a 64-bit hash of its language, half and letters,
so the columns ``h2, h1, h0`` (two words before, one before, the word) name an n-gram of
one model. Below single words stands the spelling by the character model, so a word that
was never seen still has a probability.

The logarithm of a text's probability is a sum of weights of its n-grams, one for being
there and one for being a context (see ``train``). So the model is one table of weights,
and a document's n-grams meet it in one join on 96 bits; frequent ones are split by the
skew join. The table grows with the trusted text. Nothing of it is collected or broadcast
but one row per language and half.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import common

COLUMNS = ["h2", "h1", "h0"]
ORDER = len(COLUMNS)
_UNSPACED = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_UNSPACED}]|[^\W_{_UNSPACED}]+|[^\w\s]|_")
#: Distinct words that a task keeps at a time.
_KEPT = 500_000


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def word_hash(lang: str | None, half: int, word: str) -> int:
    said = f"{lang is None}\0{lang or ''}\0{half}\0{word}".encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(said, digest_size=8).digest(), "little", signed=True)


class _Words(dict):
    """Place of each word of one model, and by place its hash, spelling and length; the border is at 0."""

    def __init__(self, lang: str | None, half: int, spell):
        self.lang, self.half, self.spell = lang, half, spell
        self.model = word_hash(lang, half, "")
        self.hashes, self.bases, self.sizes = [word_hash(lang, half, "\n")], [0.0], [0]

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self.hashes)
        self.hashes.append(word_hash(self.lang, self.half, word))
        self.bases.append(self.spell(word))
        self.sizes.append(len(word) + 1)
        return place

    def places(self, text: str | None) -> np.ndarray:
        """Two borders and the words of the text."""
        w = words_of(text)
        return np.concatenate([[0, 0], np.fromiter(map(self.__getitem__, w), np.int64, len(w))])

    def take(self, name: str, places: np.ndarray) -> np.ndarray:
        held = getattr(self, name)
        return np.array([held[i] for i in places.tolist()], np.float64 if name == "bases" else np.int64)


#: Features that ``tokens`` gives: ``level`` words of the text with their number ``n`` as an
#: n-gram and ``m`` as a context; at level 0 the whole row, with its words, spelling and size.
LEVELS = (0, 1, 2, 3)
SCHEMA = "row long, model long, level int, h2 long, h1 long, h0 long, base double, size long, n long, m long"


def _counted(at: np.ndarray, levels: tuple[int, ...], known: _Words) -> Iterator[tuple]:
    """Per level the places ``(p2, p1, p0)``, ``n`` and ``m`` of each distinct n-gram of a row."""
    # The first pair is only a context and the last one only an n-gram; the same with words.
    pairs, pair = np.unique(at[:-1] << 32 | at[1:], return_inverse=True)
    p1, p0 = pairs >> 32, pairs & 0xFFFFFFFF
    if 1 in levels:
        words, word = np.unique(at[1:], return_inverse=True)
        n, m = (np.bincount(x, minlength=len(words)) for x in (word[1:], word[:-1]))
        yield 1, None, None, words, n, m
    if 2 in levels:
        n, m = (np.bincount(x, minlength=len(pairs)) for x in (pair[1:], pair[:-1]))
        yield 2, None, p1, p0, n, m
    if 3 in levels:
        grams, n = np.unique(at[:-2] << 32 | pair[1:], return_counts=True)
        last = grams & 0xFFFFFFFF
        yield 3, grams >> 32, p1[last], p0[last], n, np.zeros(len(n), np.int64)


def tokens(docs: DataFrame, spellers, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """The distinct n-grams of each row of (row, lang, half, text), with their numbers.

    ``half`` names the model; ``spellers()`` gives per half the logarithm of a word's spelling.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = spellers()
        held: dict[tuple, _Words] = {}
        for batch in batches:
            parts = []
            for row, lang, half, text in zip(*(c.to_pylist() for c in batch.columns)):
                if sum(map(len, held.values())) > _KEPT:
                    held.clear()
                known = held.get((lang, half))
                if known is None:
                    known = held[lang, half] = _Words(lang, half, spell[half])
                at = known.places(text)
                if len(at) == 2:
                    continue
                if 0 in levels:
                    base, size = (known.take(name, at[2:]).sum() for name in ("bases", "sizes"))
                    whole = (row, known.model, 0, row, 0, 0, base, size, len(at) - 2, 0)
                    parts.append([np.array([v]) for v in whole])
                for level, p2, p1, p0, n, m in _counted(at, levels, known):
                    same = lambda v: np.full(len(p0), v)
                    hashes = [same(0) if p is None else known.take("hashes", p) for p in (p2, p1, p0)]
                    base, size = (known.take(name, p0) for name in ("bases", "sizes"))
                    parts.append([same(row), same(known.model), same(level), *hashes, base, size, n, m])
            if parts:
                columns = [np.concatenate(c) for c in zip(*parts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int32() if at == 2 else None) for at, c in enumerate(columns)],
                    names=["row", "model", "level", *COLUMNS, "base", "size", "n", "m"],
                )

    return docs.select("row", "lang", "half", "text").mapInArrow(run, SCHEMA)


def discounts(level: DataFrame) -> DataFrame:
    """Per model the three discounts of an order, from its counts of counts."""
    c = level.groupBy("model").agg(*[F.count_if(F.col("n") == k).alias(f"c{k}") for k in (1, 2, 3, 4)])
    y = F.when(F.col("c1") > 0, F.col("c1") / (F.col("c1") + 2 * F.col("c2"))).otherwise(0.0)

    def one(k: int) -> Column:
        raw = F.when(F.col(f"c{k}") > 0, k - (k + 1) * y * F.col(f"c{k + 1}") / F.col(f"c{k}")).otherwise(0.5 * k)
        return F.least(F.greatest(raw, F.lit(0.05)), F.lit(k - 0.05)).alias(f"d{k}")

    return c.select("model", *[one(k) for k in (1, 2, 3)])


def _key(level: int | Column, *words: str | Column) -> list[Column]:
    """96 bits that stand for an n-gram wherever documents and weights meet."""
    level = F.lit(level) if isinstance(level, int) else level
    words = [F.lit(0).cast("long")] * (ORDER - len(words)) + list(words)
    return [F.xxhash64(level, *words).alias("key"), F.hash(level, *words).alias("check")]


def train(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(model, rest) for words that no model has seen, and the weights (key, check, wn, wm) of all n-grams.

    With interpolation an unseen n-gram has the context's ``rest`` times the lower order's
    probability. So the logarithm of any text is a sum over its n-grams: ``wm`` is the
    logarithm of ``rest``, due wherever the n-gram is a context, and ``wn`` what a seen n-gram
    has above ``rest`` and the lower order. No order needs to know what another one found.
    """
    # By context, so that counts and the sums of each context take one exchange.
    counts = grams.where(F.col("level") == ORDER).repartition(*COLUMNS[:-1]).groupBy("model", *COLUMNS)
    counts = counts.agg(F.sum("n").alias("n"), F.first("base").alias("base"))
    within = Window.partitionBy(*COLUMNS[:-1])
    sums = {"total": F.sum("n").over(within), "first": F.row_number().over(within.orderBy("h0")) == 1}
    sums |= {f"n{k}": F.count_if(F.col("n") == k).over(within) for k in (1, 2)}
    sums |= {"n3": F.count_if(F.col("n") > 2).over(within)}
    levels = [common.stage(counts.withColumns(sums), "words")]
    for order in range(ORDER - 1, 0, -1):
        lower = levels[0].groupBy("model", *COLUMNS[-order:]).agg(F.count("*").alias("n"), F.first("base").alias("base"))
        levels.insert(0, common.stage(lower, "words"))
    weights, p, lowest = [], None, None
    none = F.lit(0.0)
    for order, level in enumerate(levels, 1):
        gram = COLUMNS[-order:]
        context = gram[:-1] or ["model"]
        taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        held = level.join(F.broadcast(discounts(level)), "model").withColumn("taken", taken)
        if order == ORDER:
            held = held.withColumn("rest", sum(F.col(f"d{k}") * F.col(f"n{k}") for k in (1, 2, 3)) / F.col("total"))
            contexts = held.where("first")
        else:
            contexts = common.stage(
                held.groupBy(*context).agg(F.sum("n").alias("total"), (F.sum("taken") / F.sum("n")).alias("rest")), "contexts"
            )
            # One row per model at order 1.
            held = held.join(F.broadcast(contexts) if order == 1 else contexts, context)
        if order == 1:
            lowest = contexts.drop("total")
            held = held.withColumn("ln_below", F.col("base"))
        else:
            weights.append(contexts.select(*_key(order - 1, *context), none.alias("wn"), F.ln("rest").alias("wm")))
            held = held.join(p.select(*gram[1:], F.ln("p").alias("ln_below")), gram[1:])
        share = (F.col("n") - F.col("taken")) / F.col("total")
        held = held.withColumn("p", share + F.col("rest") * F.exp("ln_below"))
        held = held.select(*gram, "p", (F.ln("p") - F.ln("rest") - F.col("ln_below")).alias("wn"))
        p = held = common.stage(held, "words") if order < ORDER else held
        weights.append(held.select(*_key(order, *gram), "wn", none.alias("wm")))
    return lowest, reduce(DataFrame.unionByName, weights)


def score(grams: DataFrame, model: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Per row of ``tokens``: ``logs``, the sum of all logarithms, and ``size``, its characters."""
    lowest, weights = model
    whole = F.col("level") == 0
    # Only what is summed goes through the exchange; words of no model keep their spelling.
    alone = F.col("base") + F.col("n") * F.coalesce(F.ln("rest"), F.lit(0.0))
    due = grams.join(F.broadcast(lowest), "model", "left").select(
        *_key(F.col("level"), *COLUMNS),
        "row",
        F.when(whole, 0).otherwise(F.col("n")).cast("int").alias("n"),
        F.col("m").cast("int").alias("m"),
        F.when(whole, alone).alias("alone"),
        F.when(whole, F.col("size")).alias("size"),
    )
    found = F.col("n") * F.col("wn") + F.col("m") * F.col("wm")
    logs = F.coalesce("alone", F.lit(0.0)) + F.coalesce(found, F.lit(0.0))
    return due.join(weights, ["key", "check"], "left").groupBy("row").agg(F.sum(logs).alias("logs"), F.sum("size").alias("size"))


# Functions of this module travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
