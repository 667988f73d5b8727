"""Near duplicates."""

import random

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from lectern.llm import common, near

rng = random.Random(17)


def edited(text, n):
    words = text.split(" ")
    for at in rng.sample(range(len(words)), n):
        words[at] = plain.sentence(rng, 1)
    return " ".join(words)


def family(words, copies, edits):
    origin = plain.sentence(rng, words)
    return [edited(origin, rng.randint(0, edits)) for _ in range(copies)]


SHARED = plain.sentence(rng, 40)
TEXTS = (
    [None, "", " \t\n", "one", "ONE", "one two", "One\tTwo", "é É", "a b c", "a b c d"]
    + family(60, 12, 6) + family(100, 25, 9) + family(30, 6, 2) + family(12, 6, 1)
    + [f"{plain.sentence(rng, 20)} {SHARED}" for _ in range(12)]
    + [plain.sentence(rng, 2000)] * 2
)


@pytest.mark.parametrize("size", [2, 5])
def test_components_equal_all_pairs(docs, size):
    rows = {r["doc_id"]: r for r in near.group(docs(*TEXTS), near.Settings(shingle=size)).collect()}
    want = plain.near_components(dict(enumerate(TEXTS)), size, 80)
    assert {i: r["component_id"] for i, r in rows.items()} == want
    assert {i: r["n_shingles"] for i, r in rows.items()} == {i: len(plain.shingle_set(t, size)) for i, t in enumerate(TEXTS)}
    assert all(r["kept"] == (i == want[i]) for i, r in rows.items())


@pytest.mark.parametrize("rounds, block", [(1, 256), (2, 7)])
def test_crowded_buckets(docs, monkeypatch, rounds, block):
    """All texts in one bucket: what the stars leave, the families settle."""
    texts = family(40, 20, 10) + family(40, 20, 10) + [f"{SHARED} {plain.sentence(rng, 3)}" for _ in range(15)]
    settings = near.Settings(shingle=1, rounds=rounds)
    table = docs(*texts)
    postings = table.select(F.col("doc_id").alias("id"), F.lit(1).alias("key"))
    named = table.select(F.col("doc_id").alias("id"), "text")
    stars = near.star_links(postings, lambda ids: named.join(ids, "id", "left_semi"), settings)
    roots = near.components(stars.links)
    monkeypatch.setattr(near, "_BLOCK", block)
    more = near.family_links(near.open_families(stars, roots, settings), stars.pool, settings)
    got = {r["id"]: r["root"] for r in near.components(stars.links.unionByName(more)).collect()}
    want = plain.near_components(dict(enumerate(texts)), 1, 80)
    assert {i: got.get(i, i) for i in want} == want


def test_components_of_chains_and_hubs(spark):
    chain = [(i + 1, i) for i in range(10, 60)]
    hub = [(100, i) for i in range(101, 160)] + [(500, 501), (501, 500), (7, 7)]
    edges = spark.createDataFrame(chain + hub, "a long, b long").repartition(7)
    got = {r["id"]: r["root"] for r in near.components(edges).collect()}
    assert got == {**{i: 10 for i in range(11, 61)}, **{i: 100 for i in range(101, 160)}, 501: 500}
    assert near.components(edges.limit(0)).count() == 0


def test_signature_estimates_similarity():
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 900, dtype=np.uint64)
    a, b = base[:800], base[100:]
    docs = np.repeat([0, 1], [len(a), len(b)])
    sig = near.signatures(docs, np.concatenate([a, b]), 2, 512, 1)
    assert abs((sig[0] == sig[1]).mean() - 700 / 900) < 0.06
    # In parts or at once, alone or together: the same signature.
    alone = near.signatures(np.zeros(len(a), dtype=np.int64), a, 1, 512, 1)
    assert (alone[0] == sig[0]).all()
    small = near.signatures(np.array([0]), base[:1], 1, 64, 1)
    assert sorted(small[0] >> np.uint64(50)) == list(range(64))


def test_long_texts_walk_in_parts(monkeypatch):
    docs, hashes = near.shingle_sets([plain.sentence(rng, 700), plain.sentence(rng, 30)], 2)
    whole = near.signatures(docs, hashes, 2, 64, 1)
    monkeypatch.setattr(near, "_TOGETHER", 97)
    assert (near.signatures(docs, hashes, 2, 64, 1) == whole).all()


def test_selection_and_edge_tables(spark, docs):
    text = plain.sentence(rng, 40)
    table = docs(
        (5, text, "en", "a", 1), (3, text.upper(), "en", "a", 1), (None, text, None, None, None),
        (9, None, None, None, None), (9, None, None, None, None), (4, "", "en", "a", 0),
    ).withColumn("kept", F.lit("mine"))
    rows = near.select(table).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == [(False, 3), (False, 4), (False, 9), (False, 9)]
    assert {r["kept"] for r in rows} == {"mine"}
    assert near.select(docs().limit(0)).count() == 0


def test_rows_that_share_an_id(docs):
    a, b = plain.sentence(rng, 60), plain.sentence(rng, 60)
    rows = [(1, a), (1, b), (5, a + " more"), (6, b + " more"), (None, a + " else"), (9, b), (9, plain.sentence(rng, 60)), (None, "alone here")]
    table = docs(*[(i, t, "en", "s", 1) for i, t in rows])
    parts = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near.group(table).collect()), key=repr)
    assert parts == sorted([
        (1, 1, True), (1, 1, True), (5, 1, False), (6, 1, False), (None, 1, False), (9, 1, False), (9, 9, True), (None, None, True),
    ], key=repr)
    kept = sorted((r["text"] for r in near.select(table).collect()))
    assert kept == sorted([a, b, rows[6][1], "alone here"])


def test_one_of_equal_rows_stays(docs):
    text = plain.sentence(rng, 40)
    table = docs(*[(2, text, "en", "s", 1)] * 5, *[(None, "no id " + text, None, None, None)] * 3, (4, "  ", "en", "s", 1), (4, "  ", "en", "s", 1))
    kept = sorted(r["text"] for r in near.select(table).collect())
    # The texts without an id are near the others, too.
    assert kept == sorted([text, "  ", "  "])


def test_query(spark, docs, saved):
    got = near.op6(spark, saved(documents=docs(*TEXTS)))
    assert got.columns[:4] == ["doc_id", "n_shingles", "component_id", "kept"]
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == plain.near_components(dict(enumerate(TEXTS)), 2, 80)
