"""License scan."""

import random

import plain

from lectern.llm import licenses

rng = random.Random(43)
MIT, APACHE = licenses.TEMPLATES["mit"][0], licenses.TEMPLATES["apache-2"][0]


def changed(text, n):
    words = text.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = plain.sentence(rng, 1)
    return " ".join(words)


TEXTS = [
    None, "", "Under the MIT License, under the mit license", "APACHE license: version 2.0!", "cc-by-nc CC BY NC 4",
    "xunder the mit license", "éunder the mit license", "中under the mit license under the mit licenseé",
    plain.sentence(rng, 200), "license " * 5_000,
] + [plain.sentence(rng, rng.randint(1, 80)) + " Under the MIT License cc by nc" * (i % 3) for i in range(30)]


def words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", plain.ascii_lower(text))


def test_phrases_equal_plain_search(spark, docs, saved):
    rows = {r["doc_id"]: r for r in licenses.op8(spark, saved(documents=docs(*TEXTS))).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        w, at, labels = words(text), [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            hits = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            at += hits
            labels |= {label} if hits else set()
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted(labels)) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


def test_notices_are_placed(docs):
    filler = lambda n: plain.sentence(rng, n)
    words = MIT.split()
    rng.shuffle(words)
    texts = [
        f"{filler(50)} {MIT} {filler(50)} {APACHE}", f"{filler(9)} {changed(MIT, 0)[:-40]}", " ".join(words),
        MIT.replace("free of charge", "for a fee"), *[filler(100) for _ in range(200)],
    ] + [licenses.TEMPLATES[label][0] for label in licenses.TEMPLATES]
    rows = {r["doc_id"]: r for r in licenses.scan(docs(*texts)).collect()}
    assert rows[0]["labels"] == "apache-2,mit" and rows[1]["labels"] == "mit"
    assert rows[2]["labels"] == "" and rows[3]["labels"] == "" and not any(rows[i]["labels"] for i in range(4, 204))
    for i, label in enumerate(licenses.TEMPLATES, 204):
        assert label in rows[i]["labels"].split(",")


SHORT = {
    "This work is licensed under the GNU General Public License, version 3.": "gpl-3",
    "Licensed under the BSD 3-Clause License.": "bsd-3-clause", "SPDX-License-Identifier: MPL-2.0": "mpl-2", "MIT License": "mit",
    "// SPDX-License-Identifier: Apache-2.0 OR MIT": "apache-2", "Released under the GNU GPL v2 or later": "gpl-2",
    "distributed under the Mozilla Public License, v. 2.0": "mpl-2", "# SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3",
    "Version 3, 29 June 2007: GNU GENERAL PUBLIC LICENSE": None, "GNU GENERAL PUBLIC LICENSE Version 2, June 1991": None,
    "Licensed under CC BY-SA 4.0": "cc-by-sa-4", "This is licensed under the terms of a contract, version 3.": "", "spdx": "",
    "The public licence office is open; a general version of it, 3 rooms.": "", "licensed under the sea": "", "bsd mit apache gpl": "",
}


def test_short_forms(docs):
    """One-line grants, names with versions and identifier lines, alone and inside other text."""
    lines = list(SHORT)
    around = [f"{plain.sentence(rng, 60)}\n{line}\n{plain.sentence(rng, 60)}" for line in lines]
    rows = {r["doc_id"]: r for r in licenses.scan(docs(*lines, *around, *[plain.sentence(rng, 80) for _ in range(300)])).collect()}
    for k, line in enumerate(lines * 2):
        if SHORT[line] is not None:
            assert (SHORT[line] in rows[k]["labels"].split(",")) if SHORT[line] else rows[k]["labels"] == "", line
            assert SHORT[line] == "" or 0.6 <= rows[k]["score"] < 1
    assert not any(rows[k]["labels"] for k in range(2 * len(lines), 2 * len(lines) + 300))


def test_frequencies_and_edge_tables(docs):
    n, held = licenses.frequencies(docs("the software", "software SOFTWARE", None, ""))
    assert n == 4 and held[b"software"] == 2 and held[b"the"] == 1 and b"warranty" not in held
    assert licenses.scan(docs().limit(0)).count() == 0
    assert licenses.scan(docs(*[(None, MIT, None, None, None)] * 2).withColumnRenamed("source", "score")).count() == 2
