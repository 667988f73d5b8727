"""Token counts."""

import random

import plain

from lectern.llm import tokens

rng = random.Random(47)
TEXTS = [None, "", "a", "a", plain.sentence(rng, 4000), "é中𝄞" * 50, "x" * 20_000] + [plain.sentence(rng, rng.randint(1, 900)) for _ in range(60)]


def lengths():
    with open(tokens.VOCABULARY, "rb") as file:
        encoding = tokens.encoder(file.read())
    return [len(encoding.encode_ordinary(t or "")) for t in TEXTS]


def test_histogram_and_sums(spark, docs, saved):
    n = lengths()
    rows = tokens.op9(spark, saved(documents=docs(*TEXTS))).collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(set(n))
    for r in rows:
        size = r["n_tokens"]
        assert (r["n_docs"], r["docs_from"], r["docs_to"]) == (n.count(size), sum(x >= size for x in n), sum(x <= size for x in n))
        assert r["tokens_from"] == sum(x for x in n if x >= size) and r["truncated_total"] == sum(min(x, size) for x in n)


def test_limits_and_quantiles(docs):
    n = lengths()
    sums = tokens.suffix_sums(tokens.histogram(docs(*TEXTS))).cache()
    for r in tokens.at_limits(sums, [0, 1, 77, 512, 4096, 10**6]).collect():
        assert (r["longer"], r["truncated_total"]) == (sum(x > r["context"] for x in n), sum(min(x, r["context"]) for x in n))
    for r in tokens.quantiles(sums, [0.01, 0.5, 0.9, 1.0]).collect():
        assert r["n_tokens"] == next(x for x in sorted(n) if sum(y <= x for y in n) >= r["share"] * len(n))


def test_edge_tables(docs):
    assert tokens.suffix_sums(tokens.histogram(docs().limit(0))).count() == 0
    rows = tokens.suffix_sums(tokens.histogram(docs(None, None).withColumnRenamed("source", "n_tokens"))).collect()
    assert [tuple(r) for r in rows] == [(0, 2, 2, 0, 2, 0)]


def test_long_runs():
    """Runs of any length count like the same text in parts."""
    with open(tokens.VOCABULARY, "rb") as file:
        encoding = tokens.encoder(file.read())
    for run in (" ", "\t", "\n", " \u00a0\r\n\u3000"):
        for before, after in (("", ""), ("a", ""), ("", "b"), ("it's", "1"), ("x ", "\x1c"), ("", "!")):
            text = before + run * 12_000 + after
            assert tokens.ordinary(encoding, text) == encoding.encode_ordinary(text)
            assert tokens.ordinary(encoding, text * 2) == encoding.encode_ordinary(text * 2)
    for char in " \tx7":
        ids = tokens.ordinary(encoding, char * 1_500_000)
        assert encoding.decode(ids) == char * 1_500_000
        assert len(ids) == 1_500_000 // len(encoding.decode(ids[:1]))


def test_long_run_as_a_document(docs):
    rows = tokens.histogram(docs(" " * 1_500_000, "x")).collect()
    assert sorted(tuple(r) for r in rows) == [(1, 1), (1_500_000, 1)]
