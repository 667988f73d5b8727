"""License scan with a positional index of rare tokens.

Word frequencies of the licence vocabulary over all documents give each template word its
inverse document frequency; the highest of each template go into an index from word to
(template, position). A document looks up its licence words; hits whose document and
template positions have nearly the same difference support one placement of a template.
A placement counts when its hits hold a large enough part of the template's weight and
every mandatory phrase of the template, or one of its alternatives, stands in the placed
stretch. A licence has several templates: its notice, the head of its full text, one-line
grants with each of its names, and its identifier lines. Short phrases that name a licence
are found as they are.

Defined results: null and empty texts have no words and no labels; very long texts are scanned
whole; equal rows get equal
labels; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import common

# Phrases with their labels, and well-known licence notices with the
# phrases that each must have.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
TEMPLATES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
        " associated documentation files (the Software), to deal in the Software without restriction, including"
        " without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell"
        " copies of the Software, and to permit persons to whom the Software is furnished to do so",
        ["permission is hereby granted free of charge", "sublicense and or sell"],
    ),
    "apache-2": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in"
        " compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,"
        " software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR"
        " CONDITIONS OF ANY KIND, either express or implied.",
        ["apache license version 2", "except in compliance with the license"],
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
        " that the following conditions are met: Redistributions of source code must retain the above copyright"
        " notice, this list of conditions and the following disclaimer. Redistributions in binary form must"
        " reproduce the above copyright notice, this list of conditions and the following disclaimer in the"
        " documentation and/or other materials provided with the distribution. Neither the name of the copyright"
        " holder nor the names of its contributors may be used to endorse or promote products derived from this"
        " software without specific prior written permission.",
        ["redistribution and use in source and binary forms", "neither the name of"],
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
        " hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        ["with or without fee is hereby granted"],
    ),
    "gpl-3": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY"
        " WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        ["gnu general public license", "version 3 of the license"],
    ),
    "gpl-2": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation; either version 2 of the License, or (at your"
        " option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY"
        " WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        ["gnu general public license", "version 2 of the license"],
    ),
    "mpl-2": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL"
        " was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        ["mozilla public license v 2"],
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,"
        " publish, use, compile, sell, or distribute this software, either in source code form or as a compiled"
        " binary, for any purpose, commercial or non-commercial, and by any means.",
        ["unencumbered software released into the public domain"],
    ),
    "cc-by-4": (
        "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of"
        " this license, visit http://creativecommons.org/licenses/by/4.0/",
        ["creative commons attribution 4"],
    ),
}
# Heads of full texts, names and identifiers of licences.
BODIES = {
    "gpl-3": (
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Everyone is permitted to copy and distribute verbatim"
        " copies of this license document, but changing it is not allowed.",
        ["version 3 29 june 2007"],
    ),
    "gpl-2": (
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Everyone is permitted to copy and distribute verbatim"
        " copies of this license document, but changing it is not allowed.",
        ["version 2 june 1991"],
    ),
    "apache-2": (
        "Apache License Version 2.0, January 2004 TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        ["version 2 0 january 2004"],
    ),
    "mpl-2": (
        "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity"
        " that creates, contributes to the creation of, or owns Covered Software.",
        ["mozilla public license version 2"],
    ),
}
NAMES = {
    "mit": ["mit license", "mit licence", "expat license"],
    "apache-2": ["apache license 2", "apache 2 0 license", "apache license version 2", "apache license v2"],
    "bsd-3-clause": ["bsd 3 clause", "3 clause bsd", "three clause bsd", "new bsd license", "revised bsd license"],
    "bsd-2-clause": ["bsd 2 clause", "2 clause bsd", "two clause bsd", "simplified bsd license"],
    "isc": ["isc license"],
    "gpl-3": [
        "gnu general public license version 3", "gnu general public license v3", "gnu gpl version 3", "gnu gpl v3", "gplv3",
        "gpl version 3", "gpl v3",
    ],
    "gpl-2": [
        "gnu general public license version 2", "gnu general public license v2", "gnu gpl version 2", "gnu gpl v2", "gplv2",
        "gpl version 2", "gpl v2",
    ],
    "lgpl-3": ["gnu lesser general public license version 3", "gnu lesser general public license v3", "lgpl v3", "lgplv3"],
    "agpl-3": ["gnu affero general public license version 3", "gnu affero general public license v3", "agpl v3", "agplv3"],
    "mpl-2": ["mozilla public license version 2", "mozilla public license v 2", "mozilla public license 2", "mpl v2"],
    "cc-by-4": ["creative commons attribution 4", "cc by 4"],
    "cc-by-sa-4": ["creative commons attribution sharealike 4", "cc by sa 4"],
    "cc-by-nc": ["creative commons attribution noncommercial", "cc by nc"],
    "unlicense": ["the unlicense"],
}
IDENTIFIERS = {
    "mit": ["MIT"], "apache-2": ["Apache-2.0"], "bsd-3-clause": ["BSD-3-Clause"], "bsd-2-clause": ["BSD-2-Clause"],
    "isc": ["ISC"], "gpl-3": ["GPL-3.0"], "gpl-2": ["GPL-2.0"], "lgpl-3": ["LGPL-3.0"], "agpl-3": ["AGPL-3.0"],
    "mpl-2": ["MPL-2.0"], "cc-by-4": ["CC-BY-4.0"], "cc-by-sa-4": ["CC-BY-SA-4.0"], "cc-by-nc": ["CC-BY-NC-4.0"],
    "unlicense": ["Unlicense"],
}
GRANTS = ["licensed under the {}", "licensed under {}", "released under the {}", "distributed under the {}", "{}"]


def templates() -> Iterator[tuple[str, str, list[list[str]]]]:
    """(label, text, mandatory phrases, each as its alternatives) of all templates."""
    for table in (TEMPLATES, BODIES):
        for label, (text, phrases) in table.items():
            yield label, text, [[p] for p in phrases]
    for label, names in NAMES.items():
        for name in names:
            for grant in GRANTS:
                # A name by itself is a title line only when it says what it is.
                if grant != "{}" or "licen" in name or "clause" in name:
                    yield label, grant.format(name), [[name]]
    for label, identifiers in IDENTIFIERS.items():
        for name in identifiers:
            yield label, f"SPDX-License-Identifier: {name}", [[f"spdx license identifier {name}", f"license identifier {name}"]]


@dataclass(frozen=True)
class Settings:
    """Rare words kept per template, weight share of a placement, and how far hits may drift."""

    rare: int = 24
    share: float = 0.6
    drift: int = 8


#: The best score of a placement; only a phrase found as it is has 1.
MOST = 0.99

_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters, digits and all characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Word positions where the phrase stands."""
    line, wanted = b" " + b" ".join(words) + b" ", b" " + b" ".join(phrase) + b" "
    out, at = [], line.find(wanted)
    position = counted = 0
    while at >= 0:
        position += line.count(b" ", counted, at)
        counted = at
        out.append(position)
        at = line.find(wanted, at + 1)
    return out


class Index:
    """Templates by their rare words."""

    def __init__(self, documents: int, frequency: dict[bytes, int], settings: Settings):
        self.settings = settings
        self.postings: dict[bytes, list[tuple[int, int, float]]] = defaultdict(list)
        self.labels, self.total, self.length, self.mandatory = [], [], [], []
        for number, (label, text, phrases) in enumerate(templates()):
            words = words_of(text)
            weight = {w: math.log((documents + 1) / (frequency.get(w, 0) + 1)) + 1e-6 for w in set(words)}
            # At most half of the words of a short template: its common ones find everything.
            most = min(settings.rare, (len(weight) + 1) // 2)
            rare = set(sorted(weight, key=lambda w: (-weight[w], w))[:most])
            hits = [(i, w) for i, w in enumerate(words) if w in rare]
            self.labels.append(label)
            self.total.append(sum(weight[w] for _, w in hits))
            self.length.append(len(words))
            self.mandatory.append([[words_of(p) for p in either] for either in phrases])
            for i, w in hits:
                self.postings[w].append((number, i, weight[w]))

    def scan(self, words: list[bytes]) -> dict[str, float]:
        """Labels of the placed templates with their best share of weight."""
        if self.postings.keys().isdisjoint(words):
            return {}
        support: dict[int, list[tuple[int, int, float]]] = defaultdict(list)
        for at, word in enumerate(words):
            for number, position, weight in self.postings.get(word, ()):
                support[number].append((at - position, position, weight))
        found: dict[str, float] = {}
        for number, hits in support.items():
            label = self.labels[number]
            for stretch in self._stretches(sorted(hits)):
                covered = {position: weight for _, position, weight in stretch}
                share = min(MOST, sum(covered.values()) / self.total[number])
                if share < self.settings.share or share <= found.get(label, 0.0):
                    continue
                low = max(0, stretch[0][0] - self.settings.drift)
                part = words[low : stretch[-1][0] + self.length[number] + self.settings.drift]
                if all(any(places(part, phrase) for phrase in either) for either in self.mandatory[number]):
                    found[label] = share
        return found

    def _stretches(self, hits: list[tuple[int, int, float]]) -> Iterator[list[tuple[int, int, float]]]:
        """Hits in order of displacement, cut where it jumps by more than the drift."""
        start = 0
        for i in range(1, len(hits) + 1):
            if i == len(hits) or hits[i][0] - hits[i - 1][0] > self.settings.drift:
                yield hits[start:i]
                start = i


VOCABULARY = frozenset(w for _, text, _ in templates() for w in words_of(text))


def frequencies(docs: DataFrame) -> tuple[int, dict[bytes, int]]:
    """Number of documents, and of documents with each word of the licence vocabulary.

    The result has a row per vocabulary word, whatever the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        documents = 0
        for batch in batches:
            documents += batch.num_rows
            for text in batch.column(0):
                counts.update(VOCABULARY.intersection(words_of(text.as_py())))
        rows = [("", documents), *((w.decode("utf-8", "replace"), n) for w, n in counts.items())]
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in rows]), pa.array([n for _, n in rows], pa.int64())], names=["word", "n"]
        )

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    counts = {r["word"]: r["n"] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return counts.pop("", 0), {w.encode(): n for w, n in counts.items()}


_RESULT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string,"
    " score double"
)


def scan(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Per row: word count, places of the phrases, labels, and the best score.

    The score is 1 for a phrase, else the weight share of the best placement.
    """
    settings = settings or Settings()
    index = Index(*frequencies(docs), settings)
    phrases = [(words_of(p), label) for p, label in PHRASES.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                words = words_of(text.as_py())
                at, named = [], set()
                for phrase, label in phrases:
                    if hits := places(words, phrase):
                        at += hits
                        named.add(label)
                placed = index.scan(words)
                rows.append(
                    (
                        len(words), len(at), min(at, default=None), max(at, default=None),
                        ",".join(sorted(named)), ",".join(sorted(named | set(placed))),
                        1.0 if named else max(placed.values(), default=0.0),
                    )
                )
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types))],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _RESULT)


def op8(spark, sf) -> DataFrame:
    return scan(common.documents(spark, sf))


# Functions of this module travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
