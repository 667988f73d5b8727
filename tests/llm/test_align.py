"""Cross-tokenizer alignment."""

import hashlib
import random
from collections import Counter
from pathlib import Path

import plain
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import align

rng = random.Random(53)
TEXTS = [
    None, "", " ", "a", "a", "Hello  world\n\n again", "é中𝄞 ﬁ" * 9, "\x00\x7f<0x41> <s> </s>▁▁", "<|endoftext|>x",
    " " * 3 + "\t" * 40, "word 　  end", "x" * 900,
    *[plain.sentence(rng, rng.randint(1, 200)) for _ in range(40)],
]


@pytest.fixture(scope="module")
def both():
    return align.Tokenizers(Path(align.VOCABULARY_A).read_bytes(), Path(align.VOCABULARY_B).read_bytes())


def expected(texts, both):
    """Tokens by the public tokenizers, groups and links byte by byte."""
    json_a = Tokenizer.from_file(align.VOCABULARY_A)
    json_a.encode_special_tokens = True
    rows, pairs = [], Counter()
    for text in texts:
        links, groups, a, b = [], [], [], []
        if text:
            a, b = json_a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
            data = b" " + text.encode()
            if b"".join(both.a_bytes[i] for i in a) != data or b"".join(both.b_bytes[i] for i in b) != data:
                a, b = [], []
        owners = [[k for k, i in enumerate(ids) for _ in table[i]] for ids, table in ((a, both.a_bytes), (b, both.b_bytes))]
        links = sorted(set(zip(*owners)))
        at = [0, 0]
        for p in range(len(owners[0])):
            if p + 1 == len(owners[0]) or (owners[0][p] != owners[0][p + 1] and owners[1][p] != owners[1][p + 1]):
                groups.append((a[at[0] : owners[0][p] + 1], b[at[1] : owners[1][p] + 1]))
                at = [owners[0][p] + 1, owners[1][p] + 1]
        links = [(a[x], b[y]) for x, y in links]
        pairs.update(links)
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append([len(a), len(b), len(groups), links, hashlib.sha256(written.encode()).hexdigest() if a else ""])
    best = {}
    for (_, y), n in pairs.items():
        best[y] = max(best.get(y, 0), n)
    for r in rows:
        links = r[3]
        r[3] = len(links)
        r += [sum(pairs[x] == best[x[1]] for x in links), sum(pairs[x] for x in links)]
    return [tuple(r) for r in rows]


NAMES = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


def test_equals_byte_by_byte(spark, docs, saved, both):
    rows = align.op11(spark, saved(documents=docs(*TEXTS))).orderBy("doc_id").collect()
    assert [tuple(r[n] for n in NAMES) for r in rows] == expected(TEXTS, both)


def test_table_of_pairs_joined(docs, both):
    columns = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")
    rows = align.aligned(docs(*TEXTS), columns).cache()
    table = align.pair_table(rows, len(both.b_bytes)).cache()
    for bound in (0, 10**9):
        got = align.scored(rows, table, broadcast_pairs=bound).orderBy("row").collect()
        assert [tuple(r[n] for n in NAMES) for r in sorted(got, key=lambda r: r["doc_id"])] == expected(TEXTS, both)


def test_lists(docs, both):
    for r in align.aligned(docs(*TEXTS)).collect():
        text = TEXTS[r["doc_id"]]
        assert len(r["a_ends"]) == len(r["b_ends"])
        for x, y in zip(r["a_ends"], r["b_ends"]):
            assert b"".join(both.a_bytes[i] for i in r["a_ids"][:x]) == b"".join(both.b_bytes[i] for i in r["b_ids"][:y])
        if r["a_ids"]:
            assert b"".join(both.a_bytes[i] for i in r["a_ids"]) == b" " + text.encode()


@pytest.mark.parametrize("text", [" " * 1_500_000, "\t" * 600_000 + "x", "ab " * 300_000, "7" * 600_000])
def test_very_long_texts(text, both, monkeypatch):
    made = align.block_columns([text], both, ("n_a", "n_b", "n_groups", "n_links"))
    a, b = both.encode(text)
    assert made["n_a"][0].as_py() == len(a) and made["n_links"][0].as_py() == len(a) + len(b) - made["n_groups"][0].as_py()


def test_blocks_do_not_change_rows(spark, docs, both, monkeypatch):
    whole = align.block_columns(TEXTS, both, tuple(align.COLUMNS))
    for k, text in enumerate(TEXTS):
        one = align.block_columns([text], both, tuple(align.COLUMNS))
        assert all(one[c][0] == whole[c][k] for c in align.COLUMNS)


def test_edge_tables(spark, docs, saved):
    assert align.op11(spark, saved(documents=docs().limit(0))).count() == 0
    df = docs((None, "same words", "en", "a", 1), (None, "same words", None, None, None), (3, None, None, None, None))
    df = df.withColumns({"row": F.lit("x"), "pairs": F.lit(1), "n_a": F.lit(None)})
    assert [r["doc_id"] for r in align.aligned(df, ("n_a",)).orderBy("row").collect()] == [None, None, 3]
