"""Quality rules."""

import random

import plain
import pytest

from lectern.llm import quality

rng = random.Random(11)
COMMON = quality.COMMON["en"].split()


def prose(n):
    return " ".join(rng.choice(COMMON) if rng.random() < 0.4 else plain.sentence(rng, 1) for _ in range(n))


TEXTS = [
    None, "", "   \n\t ", "one", "a b a b a b a b", "\n".join(["same line here"] * 40), "x\n\nx\n \nx\r\nx",
    "#$%&|<>*" * 30, "é ü 中文 " * 40, prose(300) + "\n" + prose(100), " ".join(["the"] * 20_000), prose(49), prose(50),
] + [" ".join(rng.choices("abcd", k=rng.randint(1, 90))) for _ in range(60)]


def base(text):
    w = plain.words(text)
    lines = [line for line in (text or "").split("\n") if plain.words(line)]
    repeats = plain.repeat_words(w)
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), repeats,
        len(w) < 50 or 100 * repeats > 50 * len(w),
    )


def test_base_counts(spark, docs, saved):
    rows = {r["doc_id"]: r for r in quality.op7(spark, saved(documents=docs(*TEXTS))).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        assert tuple(rows[i][c] for c in quality.BASE) == base(text), repr(text)[:120]
        assert not (rows[i]["base_failed"] and rows[i]["kept"])


def plain_divergence(p, q):
    from math import log2

    return sum((a * log2(2 * a / (a + b)) if a else 0) / 2 + (b * log2(2 * b / (a + b)) if b else 0) / 2 for a, b in zip(p, q))


def test_divergence(spark):
    p, q = [0.5, 0.5, 0.0], [0.1, 0.2, 0.7]
    df = spark.createDataFrame([(p, q), (p, p), ([1.0, 0.0], [0.0, 1.0])], "p array<double>, q array<double>")
    got = [r[0] for r in df.selectExpr(quality.divergence("p", "q")).collect()]
    assert got == pytest.approx([plain_divergence(p, q), 0.0, 1.0])


def test_odd_documents_go_and_clean_ones_stay(docs):
    clean = [prose(150) for _ in range(40)]
    junk = " ".join(f"{w}{rng.choice(['***', '&&&', '###'])}" for w in prose(200).split())
    table = " | ".join(plain.sentence(rng, 1) for _ in range(400))
    kept = {r["doc_id"]: r["kept"] for r in quality.assess(docs(*clean, junk, table, prose(20))).collect()}
    assert [i for i in kept if not kept[i]] == [40, 41, 42] and all(kept[i] for i in range(40))


def test_languages_and_extra_columns(spark, docs):
    from pyspark.sql import functions as F

    rows = [(1, prose(80), "xx", "a", 1), (2, prose(80), None, None, None), (2, prose(80), None, None, None)]
    table = docs(*rows).withColumns({"kept": F.lit("mine"), "n_words": F.lit(7)})
    got = quality.select(table).collect()
    assert len(got) == 3 and {(r["kept"], r["n_words"]) for r in got} == {("mine", 7)}
    assert quality.select(docs().limit(0)).columns == docs().columns
    assert quality.assess(docs().limit(0)).count() == 0


def test_word_lists_go_at_every_length(docs):
    """Lists with few common words are odd at 140 words, and at 60, where the base rules already judge."""

    def mixed(n, share):
        return [rng.choice(COMMON) if rng.random() < share else plain.sentence(rng, 1) for _ in range(n)]

    clean = [" ".join(mixed(rng.randint(50, 400), 0.4)) for _ in range(300)]
    lists = [" | ".join(mixed(80, 0.15)) for _ in range(10)] + [" | ".join(mixed(32, 0)) for _ in range(10)]
    kept = {r["doc_id"]: r["kept"] for r in quality.assess(docs(*clean, *lists)).collect()}
    assert not any(kept[i] for i in range(300, 320)) and sum(kept[i] for i in range(300)) >= 297
    copies = {r["doc_id"]: r["kept"] for r in quality.assess(docs(*[clean[0]] * 2_000, *clean)).collect()}
    assert all(copies[i] for i in range(2_000)) and sum(copies[i] for i in range(2_000, 2_300)) >= 290
