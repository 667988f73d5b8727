"""Kneser-Ney quality classifier."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import plain
import pytest

from lectern.llm import kneser_ney as kn
from lectern.llm import word_model, word_scan, word_shards

rng = random.Random(53)
GOOD = [plain.sentence(rng, rng.randint(5, 120)) + ". Été, 12 €" for _ in range(80)]


def plain_model(texts):
    """Probability of a symbol after a context, by the recursion over counts."""
    table = kn._symbol_table()
    grams = Counter()
    for text in texts:
        symbols = [kn.BORDER] * (kn.ORDER - 1) + [int(table[min(ord(c), 0xFFFF)]) for c in text or ""]
        grams.update(tuple(symbols[i - kn.ORDER + 1 : i + 1]) for i in range(kn.ORDER - 1, len(symbols)))
    orders = [grams]
    for _ in range(kn.ORDER - 1):
        orders.append(Counter(g[1:] for g in orders[-1]))
    settings = []
    for counts in orders:
        c = [sum(v == k for v in counts.values()) for k in (1, 2, 3, 4)]
        y = c[0] / (c[0] + 2 * c[1]) if c[0] else 0
        d = [k - (k + 1) * y * c[k] / c[k - 1] if c[k - 1] else 0.5 * k for k in (1, 2, 3)]
        d = [min(max(x, 0.05), k - 0.05) for x, k in zip(d, (1, 2, 3))]
        held = defaultdict(list)
        for g, n in counts.items():
            held[g[:-1]].append(n)
        settings.append((counts, d, held))

    def probability(gram, level=0):
        if level == kn.ORDER:
            return 1 / kn.V
        counts, d, held = settings[level]
        below = probability(gram[1:], level + 1) if level < kn.ORDER - 1 else 1 / kn.V
        seen = held.get(gram[:-1])
        if not seen:
            return below
        n, total = counts.get(gram, 0), sum(seen)
        rest = sum(d[min(x, 3) - 1] for x in seen) / total
        return (n - d[min(n, 3) - 1] if n else 0) / total + rest * below

    return probability


def test_model_equals_plain_recursion(docs):
    model = kn.train(docs(*GOOD))
    probability = plain_model(GOOD)
    table = kn._symbol_table()
    for text in GOOD[:3] + ["Zq|x** #zz 99", "ba"]:
        for gram in kn.grams(text, table):
            parts = tuple(int(gram) // kn.V**k % kn.V for k in range(kn.ORDER - 1, -1, -1))
            assert model[gram] == pytest.approx(math.log(probability(parts)), rel=1e-4)
    contexts = np.exp(model.astype(np.float64)).reshape(-1, kn.V).sum(axis=1)
    assert np.allclose(contexts, 1, atol=1e-4)


def test_held_out_documents(spark, docs, saved):
    """Kept: 92 of 100 of the same kind. Not kept: 95 of 100 of noise, and no text that repeats a known one."""
    held = [plain.sentence(rng, rng.randint(5, 120)) + ". Été, 12 €" for _ in range(100)]
    noise = ["".join(rng.choices("qwxzj|#$ %&", k=300)) for _ in range(100)]
    repeated = [". Été, 12 € " * (20 + i) for i in range(10)]
    table = docs(*GOOD, *held, *noise, *repeated)
    labels = spark.createDataFrame(
        [(i, 1, 0) for i in range(80)] + [(180 + i, 0, 0) for i in range(40)] + [(None, 1, 0), (3, 1, 0), (81, 1, 1), (5, None, None)],
        "doc_id long, quality int, toxic int",
    )
    rows = {r["doc_id"]: r for r in kn.op10(spark, saved(documents=table, labels=labels)).collect()}
    assert len(rows) == 290 and sum(rows[i]["kept"] for i in range(80, 180)) >= 92
    assert not any(rows[i]["kept"] for i in range(280, 290))
    assert sum(not rows[i]["kept"] for i in range(180, 280)) >= 95


def test_thresholds_equal_plain_quantiles(spark, docs):
    """Both thresholds by language and length, and the verdict, from sorted lists."""
    rows = [(i, plain.sentence(rng, rng.choice([6, 60])), rng.choice(["en", "fr"]), "a", 1) for i in range(150)]
    rows += [(200, "ba ba ba " * 40, "en", "a", 1), (201, "zq# " * 40, "fr", "a", 1), (202, "ba", "xx", "a", 1)]
    trusted = set(range(0, 140))
    labels = spark.createDataFrame([(i, 1, 0) for i in trusted], "doc_id long, quality int, toxic int")
    settings = kn.Settings(low=0.1, high=0.9, class_documents=30)
    got = {r["doc_id"]: r for r in kn.classify(docs(*rows), labels, settings).collect()}

    def quantile(values, q):
        return sorted(values)[max(0, math.ceil(q * len(values)) - 1)]

    for i, text, lang, _, _ in rows:
        mine = [j for j, _, other, _, _ in rows if j in trusted and other == lang]
        near = [j for j in mine if len(rows[j][1]).bit_length() == len(text).bit_length()]
        values = [got[j]["perplexity"] for j in (near if len(near) >= 30 else mine)]
        want = (quantile(values, 0.1), quantile(values, 0.9)) if values else (None, None)
        r = got[i]
        assert (r["lowest"], r["threshold"]) == want
        assert r["kept"] == (want[0] is None or want[0] <= r["perplexity"] <= want[1])


def test_edge_tables(spark, docs):
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    rows = [(0, GOOD[0], "en", "a", 1), (1, None, "en", "a", 1), (1, "", None, None, None), (2, "#" * 50_000, "xx", "a", 1), (None, "ba", None, None, None)]
    table = docs(*rows).withColumnRenamed("source", "perplexity")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["kept"]) for r in kn.classify(table, labels).collect())
    assert got == [(False, 0, True), (False, 1, False), (False, 1, False), (False, 2, True), (True, 0, True)]
    assert kn.classify(docs(*rows), labels.limit(0)).where("kept").count() == 3
    assert kn.classify(docs().limit(0), labels).count() == 0


def plain_words(texts, half):
    """Probability of a word after two others, by the recursion over counts of words."""
    grams = Counter()
    for text in texts:
        w = ["\n", "\n", *word_model.words_of(text)]
        grams.update(tuple(w[i - 2 : i + 1]) for i in range(2, len(w)))
    orders = [grams]
    for _ in range(2):
        orders.append(Counter(g[1:] for g in orders[-1]))
    settings = []
    for counts in orders:
        c = [sum(v == k for v in counts.values()) for k in (1, 2, 3, 4)]
        y = c[0] / (c[0] + 2 * c[1]) if c[0] else 0
        d = [k - (k + 1) * y * c[k] / c[k - 1] if c[k - 1] else 0.5 * k for k in (1, 2, 3)]
        held = defaultdict(list)
        for g, n in counts.items():
            held[g[:-1]].append(n)
        settings.append((counts, [min(max(x, 0.05), k - 0.05) for x, k in zip(d, (1, 2, 3))], held))

    def probability(gram, spelled, level=0):
        if level == 3:
            return spelled
        counts, d, held = settings[level]
        below = probability(gram[1:], spelled, level + 1)
        seen = held.get(gram[:-1])
        if not seen:
            return below
        n, total = counts.get(gram, 0), sum(seen)
        return (n - d[min(n, 3) - 1] if n else 0) / total + sum(d[min(x, 3) - 1] for x in seen) / total * below

    return probability


def test_word_model_equals_plain_recursion(spark):
    texts = ["The cat sat on the mat. the cat sat", "a cat, the dog: the cat ran", "слово за слово и слово", "猫坐在猫上"]
    spell = lambda: [lambda word: -3.0 * len(word)] * 2
    make = lambda rows: word_model.tokens(spark.createDataFrame(rows, "row long, lang string, half int, text string"), spell)
    model = word_model.train(make([(i, "en", 0, t) for i, t in enumerate(texts)] + [(9, "de", 0, "the mat the mat"), (9, "en", 1, "the")]))
    asked = ["the cat sat on a dog", "猫坐", "слово unseen слово и", "the the the"]
    got = {r["row"]: (r["logs"], r["size"]) for r in word_model.score(make([(i, "en", 0, t) for i, t in enumerate(asked)]), model).collect()}
    probability = plain_words(texts, 0)
    for i, text in enumerate(asked):
        w = ["\n", "\n", *word_model.words_of(text)]
        want = sum(math.log(probability(tuple(w[k - 2 : k + 1]), math.exp(-3.0 * len(w[k])))) for k in range(2, len(w)))
        assert got[i] == (pytest.approx(want, rel=1e-9), sum(len(x) + 1 for x in w[2:]))


def test_word_order_counts_in_every_script(spark, docs):
    """Shuffled words are more surprising than their order in trusted text, Cyrillic too."""
    line = {"en": "the quick brown fox jumps over the lazy dog", "ru": "быстрая лиса прыгает через очень ленивую собаку"}
    good = [(i, f"{line[lang]}. {plain.sentence(rng, 3)} {line[lang]}", lang, "a", 1) for i, lang in enumerate(["en", "ru"] * 30)]
    odd = [(100 + k, " ".join(rng.sample(line[lang].split(), len(line[lang].split()))), lang, "a", 1) for k, lang in enumerate(["en", "ru"] * 5)]
    same = [(200 + k, line[lang], lang, "a", 1) for k, lang in enumerate(["en", "ru"])]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["perplexity"] for r in kn.classify(docs(*good, *odd, *same), labels).collect()}
    for k in range(10):
        assert got[100 + k] > 1.2 * got[200 + k % 2]


def test_ngrams_meet_the_model_once(spark):
    """One exchange holds the n-grams of the documents: they are dealt out by key, then summed by row."""
    spell = lambda: [lambda word: -2.0 * len(word)] * 2
    make = lambda rows: word_model.tokens(spark.createDataFrame(rows, "row long, lang string, half int, text string"), spell)
    model = word_model.train(make([(i, "en", 0, f"the cat sat on mat {i % 7}") for i in range(40)]))
    asked = word_model.score(make([(1, "en", 0, "the cat sat"), (2, "en", 0, "dog"), (3, "xx", 1, "dog"), (4, "en", 0, "y" * 100_000)]), model)
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join LeftOuter" in line]
    assert sum("key#" in line for line in joins) == 1 and sum("model#" in line for line in joins) == 1 and len(joins) == 2
    got = {r["row"]: (r["logs"], r["size"]) for r in asked.collect()}
    probability = plain_words([f"the cat sat on mat {i % 7}" for i in range(40)], 0)
    for row, text in ((1, "the cat sat"), (2, "dog"), (4, "y" * 100_000)):
        w = ["\n", "\n", *text.split()]
        # Above the spelling of a word: of the long one, exp(-200,000) is no number above 0.
        spelled = [-2.0 * len(x) for x in w[2:]]
        if row == 1:
            want = sum(math.log(probability(tuple(w[k - 2 : k + 1]), math.exp(spelled[k - 2]))) for k in range(2, len(w)))
        else:
            want = spelled[0] + math.log(probability(tuple(w), 1.0))
        assert got[row] == (pytest.approx(want, rel=1e-9), sum(len(x) + 1 for x in w[2:]))
    assert got[3] == (-6.0, 4)


def labelled(spark, rows):
    """Rows as ``word_shards.score`` takes them, from (doc_id, lang, text, half, good)."""
    return spark.createDataFrame(
        [(i, lang, text, half, 7 * i, good) for i, lang, text, half, good in rows],
        "doc_id long, lang string, text string, half int, part long, good int",
    )


@pytest.mark.parametrize("pack_chars,codes", [(10**9, 10**6), (150, 10**6), (10**9, 3)])
def test_packed_model_equals_plain_recursion(spark, monkeypatch, pack_chars, codes):
    """Many shards and packs, most words sent as hashes or as ranks: a half's texts are scored by the other half's model."""
    for name, value in {"SHARD_CHARS": 200, "PACK_CHARS": pack_chars, "CODES": codes}.items():
        monkeypatch.setattr(word_shards, name, value)
    texts = ["The cat sat on the mat. the cat sat", "a cat, the dog: the cat ran", "слово за слово и слово", "猫坐在猫上"]
    texts += [f"the cat {plain.sentence(rng, 12)}" for _ in range(20)]
    rows = [(i, "en", text, 0, 1) for i, text in enumerate(texts)] + [(100, "de", "the mat the mat", 0, 1), (101, "en", "dog dog", 1, 1)]
    asked = {200: "the cat sat on a dog", 201: "猫坐", 202: "слово unseen слово и", 203: "the the the", 204: "y" * 5_000, 205: texts[5]}
    rows += [(i, "en", text, 1, 0) for i, text in asked.items()] + [(300, "xx", "dog", 1, 0), (301, "en", " ", 1, 0), (302, None, None, 1, 0)]
    spell = lambda: [lambda words: np.array([-3.0 * len(w) for w in words])] * 2
    scored = word_shards.score(labelled(spark, rows).repartition(3), spell).collect()
    got = {r["doc_id"]: r["perplexity"] for r in scored}
    assert len(scored) == len(rows) and got[301] is None and got[302] is None and got[300] == pytest.approx(math.exp(9 / 4))
    probability = plain_words(texts, 0)
    for i, text in asked.items():
        w = ["\n", "\n", *word_model.words_of(text)]
        size = sum(len(x) + 1 for x in w[2:])
        if i == 204:
            # The spelling of the long word is no number above 0.
            want = -15_000 + math.log(probability(tuple(w), 1.0))
        else:
            want = sum(math.log(probability(tuple(w[k - 2 : k + 1]), math.exp(-3.0 * len(w[k])))) for k in range(2, len(w)))
        assert got[i] == pytest.approx(math.exp(-want / size), rel=1e-9)


def test_what_is_sent_for_a_trigram():
    """A pack sends each distinct trigram once, in few bytes: one exchanged by rows took 26."""
    local = random.Random(5)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    words = ["".join(local.choices(syllables, k=local.randint(1, 3))) for _ in range(3_000)]
    odds = [1 / (i + 1) for i in range(len(words))]
    docs = [("en", " ".join(local.choices(words, odds, k=300)), 1) for _ in range(400)]
    hashes = word_shards.hashed("en", sorted(set(words)))
    table = (hashes, np.argsort(hashes))
    pack, again = (word_shards.Pack(x, table, 4) for x in (docs + docs[:100], (docs + docs[:100])[::-1]))
    distinct = {g for _, t, _ in docs for w in [["\n", "\n", *t.split()]] for g in zip(w, w[1:], w[2:])}
    asked = [(shard, pack.asked(*ranges)) for shard, *ranges in pack.parts()]
    assert int((pack.n > 0).sum()) == len(distinct) and int(pack.n.sum()) == 500 * 300
    assert asked == [(shard, again.asked(*ranges)) for shard, *ranges in again.parts()]
    sent = sum(len(x) for _, part in asked for y in part[1:] for x in (y if isinstance(y, tuple) else [y]))
    assert sent < 5 * len(distinct)


def test_scanned_words_equal_the_pattern(monkeypatch):
    """Words, places and hashes from arrays of code points, whatever the script and wherever a text is cut."""
    monkeypatch.setattr(word_scan, "CHUNK", 40)
    scanner = word_scan.Scanner(word_scan.kinds())
    local = random.Random(7)
    texts = ["Été, 12 € ΑΣ ΑΣ. İstanbul _a_b 猫坐在 слово\tza\x1cb ﬁ ภาษา 가나다 ٣٤ ²x", "", " ", "a" * 500 + " b " * 50, "\U00020000x\U0001f600"]
    texts += ["".join(chr(local.choice([local.randrange(0x110000), local.randrange(0x3000), 32, 97])) for _ in range(60)) for _ in range(500)]
    found = [[] for _ in texts]
    for text, numbers, ends in word_scan.chunks(texts):
        hashes, starts, sizes = scanner.words("en", text)
        said = [text[i : i + n] for i, n in zip(starts.tolist(), sizes.tolist())]
        assert hashes.tolist() == scanner.hashed("en", said).tolist()
        for i, at, to in zip(numbers, [0, *np.searchsorted(starts, ends)], np.searchsorted(starts, ends)):
            found[i] += said[at:to]
    assert found == [word_model.words_of(text) for text in texts]
    every = sorted({w for words in found for w in words} | {"ab", "ba", "aab", "baa"})
    assert len(np.unique(np.concatenate([scanner.hashed(lang, every) for lang in ("en", "de", None)]))) == 3 * len(every)


def test_a_shard_counts_alone():
    """One pass over a shard gives all orders: a word's predecessors too, by what stands before it, at the end of a text as well."""
    texts = ["the cat sat", "a cat", "the cat ran", "cat", "the end"]
    table = (np.zeros(0, np.int64), np.zeros(0, np.int32))
    pack = word_shards.Pack([("en", t, 1) for t in texts] + [("en", "odd cat", 0)], table, 1)
    [(_, *ranges)] = pack.parts()
    counts = dict(word_shards.Shard([((0,), 0, pack.asked(*ranges))]).counts())
    before = defaultdict(set)
    for w in (["\n", *t.split()] for t in texts):
        for a, b in zip(w, w[1:]):
            before[b].add(a)
    n = [len(x) for x in before.values()]
    assert counts[0, "en", 1] == (*[n.count(k) for k in (1, 2, 3, 4)], len(n), sum(n)) and len(counts) == 3


def test_unknown_words_are_not_asked_for(spark):
    """Words that no trusted text has travel as one word, and what follows them does not travel."""
    rows = [("en", "the cat sat on the mat", 1), ("en", "the dog sat", 1)]
    known, bits = word_shards.ranks(spark.createDataFrame([(lang, t) for lang, t, _ in rows], "lang string, text string"))
    assert set(known.tolist()) == set(word_shards.hashed("en", ["\n", "the", "cat", "sat", "on", "mat", "dog"]).tolist()) and not bits.any()
    table = (known[:2], np.argsort(known[:2]))
    marked = word_shards.bits_of(spark.createDataFrame([(int(w),) for w in known[2:]], "word long"), len(known) - 2)
    odd = rows + [("en", "the zq sat xw on zq2 the zq3", 0)]
    pack = word_shards.Pack(odd, table, 1, bits=marked)
    sent = word_shards.Asked(pack.asked(*next(pack.parts())[1:]))
    assert len(set(sent.words.tolist())) == 7 and {word_shards.UNKNOWN} < set(sent.before.tolist())
    # The last text: after the borders, after each known word (a known or an unknown one), and its end.
    asked = [("\n", "\n", "the"), ("\n", "the", "?"), ("?", "sat", "?"), ("?", "on", "?"), ("?", "the", "?")]
    mine = word_shards.Pack([odd[-1]], table, 1, bits=marked)
    assert len(mine.h0) == len(asked) and int((mine.sent[mine.h0] == word_shards.UNKNOWN).sum()) == 4
