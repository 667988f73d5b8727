"""Benchmark decontamination."""

import random
import re

import plain
import pytest

from lectern.llm import decontam

rng = random.Random(23)
ITEMS = [plain.sentence(rng, 12) for _ in range(6)] + ["abc", None, "the " * 20]


def broken(text, edits):
    chars = list(text)
    for _ in range(edits):
        at = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[at] = "q"
        elif kind == 1:
            chars.insert(at, "q")
        else:
            del chars[at]
    return "".join(chars)


TEXTS = [None, "", "abc", "x" * 50_000, " ".join(ITEMS[:6]).upper().replace(" ", " \n ")] + [
    f"{plain.sentence(rng, 20)} {broken(rng.choice(ITEMS[:6]), n)} {plain.sentence(rng, 20)}" for n in range(12) for _ in range(3)
] + ["the the the the the " * 30, plain.sentence(rng, 300), ITEMS[0][: len(ITEMS[0]) // 2]]


@pytest.fixture
def items(spark):
    return lambda rows=ITEMS: spark.createDataFrame(list(enumerate(rows)), "item_id long, text string")


def expected(texts=TEXTS, rows=ITEMS, s=decontam.Settings()):
    out = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(rows):
            wanted = decontam.normalised(item)
            if len(wanted) < s.border_chars:
                before = r"(?<![^\W_])" if wanted[:1].isalnum() else ""
                after = r"(?![^\W_])" if wanted[-1:].isalnum() else ""
                if wanted and re.search(before + re.escape(wanted) + after, decontam.normalised(text)):
                    out[d, i] = 0
            else:
                distance = plain.distance_in(wanted, decontam.normalised(text))
                if distance <= int(len(wanted) * s.budget):
                    out[d, i] = distance
    return out


SHORT = ["who wrote it?", "paris", "4", "a b", "x" * 23, "?!"]


def test_short_items_stand_between_word_borders(docs, items):
    texts = ["so who  wrote IT? me", "comparison paris.", "44 x4 4x", "a bc, ca b", "(a b)", "x" * 23, "x" * 24, "what?!", "", None, "in-paris-in 4"]
    got = decontam.find(docs(*texts), items(SHORT)).collect()
    assert {(r["doc_id"], r["item_id"]): r["distance"] for r in got} == expected(texts, SHORT)
    assert {(0, 0), (1, 1), (4, 3), (5, 4), (10, 1), (10, 2)} <= set(expected(texts, SHORT)) and len(got) == len(expected(texts, SHORT))


@pytest.mark.parametrize("block", [1_000_000, 100])
def test_matches_equal_plain_distance(docs, items, block):
    got = decontam.find(docs(*TEXTS), items(), decontam.Settings(block_chars=block)).collect()
    assert {(r["doc_id"], r["item_id"]): r["distance"] for r in got} == expected()
    assert len(got) == len(expected()) and all(r["distance"] <= r["edits"] for r in got)


def test_clean_documents_stay(docs, items):
    from pyspark.sql import functions as F

    table = docs(*TEXTS).withColumn("item_id", F.lit("mine"))
    kept = decontam.clean(table, items(), decontam.Settings(block_chars=150)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(range(len(TEXTS))) - {d for d, _ in expected()})
    assert {r["item_id"] for r in kept} == {"mine"}


def test_query_and_edge_tables(spark, docs, items, saved):
    path = saved(documents=docs(*TEXTS, *TEXTS[:5]), benchmark=items())
    assert {(r["doc_id"], r["item_id"]) for r in decontam.op1(spark, path).collect()} == set(expected(TEXTS + TEXTS[:5]))
    assert decontam.find(docs().limit(0), items()).count() == 0
    assert decontam.find(docs(*TEXTS), items([])).count() == 0
    assert decontam.clean(docs(*TEXTS), items([None, ""])).count() == len(TEXTS)
    twice = docs((None, ITEMS[0], None, None, None), (None, ITEMS[0], None, None, None))
    assert decontam.find(twice, items([ITEMS[0], ITEMS[0]])).count() == 4


def test_search_is_exact():
    for _ in range(200):
        item = decontam.Item(0, plain.sentence(rng, 4), 0.3)
        text = plain.sentence(rng, 3) + broken(item.text, rng.randint(0, 12)) + plain.sentence(rng, 3)
        distance = plain.distance_in(item.text, text)
        hit = item.search(text)
        assert (hit[0] if hit else None) == (distance if distance <= item.edits else None)
        if hit:
            assert item.possible(text)
