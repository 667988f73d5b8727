"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are lower-cased and their white space collapsed. An item of n
characters may be found with up to ``budget * n`` edits. Cut into one more piece than
that, a match must hold one piece unchanged, so an automaton of all pieces finds every
candidate in one pass over a text. A candidate place is checked against the number of
three-character parts that so many edits must leave, and verified with Myers'
bit-parallel distance, whose column of the matrix is one integer.

Items are taken in blocks of bounded size; each block is one pass over the documents, so
the benchmark may be of any size.

Items of fewer than ``border_chars`` characters are found unchanged and between word borders
only: with edits, or inside other words, they would be found nearly everywhere.

Defined results: null and empty texts match nothing; items that are null or empty after
normalising match nothing; repeated rows and repeated items each match;
of equal distances the first place counts; an empty table gives an empty table.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import common


@dataclass(frozen=True)
class Settings:
    """Edits per character of an item, the size below which it needs word borders, characters of items per pass."""

    budget: float = 0.08
    border_chars: int = 24
    block_chars: int = 1_000_000


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


class Item:
    """One benchmark item: its pieces, three-character parts and bit masks."""

    def __init__(self, item_id: int, text: str, budget: float, border_chars: int = 0):
        self.bordered = len(text) < border_chars
        self.id, self.text, self.edits = item_id, text, 0 if self.bordered else int(len(text) * budget)
        self.masks: dict[str, int] = defaultdict(int)
        for i, char in enumerate(text):
            self.masks[char] |= 1 << i
        self.parts = {text[i : i + 3] for i in range(len(text) - 2)}

    def pieces(self) -> Iterator[tuple[str, int]]:
        n = self.edits + 1
        cuts = [len(self.text) * i // n for i in range(n + 1)]
        return ((self.text[a:b], a) for a, b in zip(cuts, cuts[1:]))

    def possible(self, window: str) -> bool:
        """An edit changes at most three of the parts."""
        found = {window[i : i + 3] for i in range(len(window) - 2)}
        return len(self.parts & found) >= len(self.parts) - 3 * self.edits

    def between_borders(self, text: str, start: int) -> bool:
        """True where the item's unchanged text at ``start`` begins and ends no word in the middle."""
        end = start + len(self.text)
        joined = [
            at for at in (start, end)
            if 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum()
        ]
        return text.startswith(self.text, start) and not joined

    def search(self, window: str) -> tuple[int, int] | None:
        """The smallest distance of the item to a part of the window and the first end of it."""
        size = len(self.text)
        full, top = (1 << size) - 1, 1 << (size - 1)
        plus, minus, score, best, end = full, 0, size, self.edits + 1, -1
        for place, char in enumerate(window):
            equal = self.masks.get(char, 0)
            vertical = equal | minus
            horizontal = (((equal & plus) + plus) ^ plus) | equal
            up = minus | (full & ~(horizontal | plus))
            down = plus & horizontal
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up, down = (up << 1) & full, (down << 1) & full
            plus = down | (full & ~(vertical | up))
            minus = up & vertical
            if score < best:
                best, end = score, place + 1
        return (best, end) if end >= 0 else None


def automaton(items: list[Item]):
    """All pieces, each with the items and offsets that it stands for."""
    import ahocorasick

    owners: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for number, item in enumerate(items):
        for piece, offset in item.pieces():
            owners[piece].append((number, offset))
    found = ahocorasick.Automaton()
    for piece, where in owners.items():
        found.add_word(piece, (len(piece), where))
    if owners:
        found.make_automaton()
    return found


def matches(text: str, items: list[Item], found) -> list[tuple[int, int, int]]:
    """(item number, distance, end) of the best place of every item in a normalised text."""
    starts: dict[int, set[int]] = defaultdict(set)
    for last, (length, where) in found.iter(text):
        for number, offset in where:
            starts[number].add(last + 1 - length - offset)
    out = []
    for number, places in starts.items():
        item, best = items[number], None
        if item.bordered:
            whole = [p for p in sorted(places) if item.between_borders(text, p)]
            if whole:
                out.append((number, 0, whole[0] + len(item.text)))
            continue
        for first, last in _runs(sorted(places), item.edits):
            low = max(0, first - item.edits)
            window = text[low : last + len(item.text) + item.edits]
            if item.possible(window) and (hit := item.search(window)) and (best is None or hit[0] < best[0]):
                best = (hit[0], low + hit[1])
        if best:
            out.append((number, *best))
    return out


def _runs(places: list[int], gap: int) -> Iterator[tuple[int, int]]:
    """First and last of the places that lie at most ``gap`` apart."""
    first = last = places[0]
    for place in places[1:]:
        if place - last > gap:
            yield first, last
            first = place
        last = place
    yield first, last


def item_blocks(items: DataFrame, settings: Settings) -> Iterator[list[tuple[int, str]]]:
    """Blocks of (item_id, normalised text) with at most ``block_chars`` characters each."""
    block: list[tuple[int, str]] = []
    size = 0
    for row in items.select("item_id", "text").orderBy("item_id").toLocalIterator():
        text = normalised(row["text"])
        if not text:
            continue
        if block and size + len(text) > settings.block_chars:
            yield block
            block, size = [], 0
        block.append((row["item_id"], text))
        size += len(text)
    if block:
        yield block


_FOUND = "doc_id long, item_id long, distance long, edits long, start long, end long"


def find(docs: DataFrame, items: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One row per document row and item found in it: distance, allowed edits, and place.

    ``end`` is the end in the normalised text; ``start`` is counted back by the item's length.
    """
    settings = settings or Settings()
    spark = docs.sparkSession
    found = spark.createDataFrame([], _FOUND)
    for block in item_blocks(items, settings):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = [Item(i, text, settings.budget, settings.border_chars) for i, text in sent.value]
            pieces = automaton(known)
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    for number, distance, end in matches(normalised(text.as_py()), known, pieces):
                        item = known[number]
                        rows.append((doc_id, item.id, distance, item.edits, max(0, end - len(item.text)), end))
                columns = list(zip(*rows)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), pa.int64()) for c in columns],
                    names=["doc_id", "item_id", "distance", "edits", "start", "end"],
                )

        found = found.unionByName(
            docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _FOUND)
        )
    return found


def clean(docs: DataFrame, items: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The documents that hold no item. Rows are judged where they are: nothing is shuffled."""
    settings = settings or Settings()
    columns = docs.columns
    for block in item_blocks(items, settings):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = [Item(i, text, settings.budget, settings.border_chars) for i, text in sent.value]
            pieces = automaton(known)
            at = columns.index("text")
            for batch in batches:
                good = [not matches(normalised(text.as_py()), known, pieces) for text in batch.column(at)]
                yield batch.filter(pa.array(good, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op1(spark, sf) -> DataFrame:
    return find(common.documents(spark, sf), common.documents(spark, sf, "benchmark"))


# Functions of this module travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
