"""Mixing sources to target weights."""

import random

import plain
import pytest
from pyspark.sql import functions as F

from lectern.llm import mixing

rng = random.Random(41)


def table(docs, sources, null_texts=3):
    rows, at = [], 0
    for source, n in sources.items():
        for _ in range(n):
            rows.append((at, plain.sentence(rng, rng.randint(1, 60)), "en", source, 1))
            at += 1
        for _ in range(null_texts):
            rows.append((at, rng.choice([None, "", " \n"]), None, source, None))
            at += 1
    rng.shuffle(rows)
    return docs(*rows)


def plain_targets(sizes):
    """Share by weight; what is above its stop goes to the others, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), {}
    while True:
        left = total - sum(stopped.values())
        going = [s for s in order if s not in stopped]
        if not going:
            return stopped
        share = {s: left * weight[s] / sum(weight[g] for g in going) for s in going}
        over = [s for s in going if share[s] > 3 * sizes[s]]
        if not over:
            return {**stopped, **share}
        stopped |= {s: 3.0 * sizes[s] for s in over}


SOURCES = [
    {"a": 200, "b": 30, "c": 5, "Z": 2, "é": 40, None: 20}, {"only": 30}, {"a": 1, "b": 1, "c": 300}, {None: 3, "": 4},
]


@pytest.mark.parametrize("sources", SOURCES)
def test_targets_and_taken_words(spark, docs, saved, sources):
    df = table(docs, sources)
    path = saved(documents=df)
    rows = mixing.op4(spark, path).collect()
    source = {r["doc_id"]: r["source"] for r in df.collect()}
    size = {r["doc_id"]: len(plain.words(r["text"])) for r in df.collect()}
    total = {s: sum(size[i] for i in size if source[i] == s) for s in sources}
    want, taken = plain_targets(total), dict.fromkeys(sources, 0)
    assert len(rows) == len(size)
    for r in rows:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], total[s]) and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in sources:
        assert abs(taken[s] - want[s]) <= 2 * 60
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.op4(spark, path).collect()))


def test_mix_emits_what_the_plan_takes(docs):
    df = table(docs, SOURCES[0]).withColumns({"size": F.lit("mine"), "target": F.lit(1)})
    planned = {r["doc_id"]: r["copies"] for r in mixing.plan(df).collect()}
    got = {}
    for r in mixing.mix(df).collect():
        got.setdefault(r["doc_id"], []).append(r["copy"])
        assert r["size"] == "mine"
    assert {i: sorted(c) for i, c in got.items()} == {i: list(range(1, n + 1)) for i, n in planned.items() if n}


def test_repeated_rows_and_edge_tables(docs):
    df = docs(*[(1, "same words here", "en", "a", 1)] * 9, *[(None, "x y", None, None, None)] * 4, (2, "z " * 500, "en", "b", 1))
    planned = mixing.plan(df)
    assert planned.count() == 14 and planned.agg(F.sum("copies")).first()[0] == mixing.mix(df).count()
    assert mixing.plan(docs().limit(0)).count() == 0 and mixing.mix(docs().limit(0)).count() == 0
    empty = docs((1, None, None, "a", None), (2, "", None, "b", 0))
    assert {r["target"] for r in mixing.plan(empty).collect()} == {0.0} and mixing.mix(empty).count() == 0
