"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Every text is encoded twice, as A (byte-level BPE) and as B (pieces with byte fallback),
both for the text with one space before it. The cumulative byte ends of the tokens go into
one dictionary per tokenizer, end to index; the ends that both have, sorted, cut the two
id lists into groups. Inside a group every distinct end closes one link, between the A and
the B token that cover the byte before it. Links are counted in the corpus by pair of ids,
so that a document's links can be told from what its tokens usually meet.

Encoding is one pass where the documents are; a task works on a bounded number of bytes at a
time. Documents keep their distinct pairs with counts; the corpus counts are one combining
aggregate over these. The table of pairs is sent to the tasks while it has at most
``BROADCAST_PAIRS`` rows; a larger one is joined with the documents' pairs.

Defined results: a null or empty text, and one whose tokens do not give its bytes back, has
no tokens and all counts 0; a very long text is a block of its own; long runs of white space
are encoded without the splitting pattern; repeated rows and ids are rows of their own and
count each; a null id stays null; further columns are not read; an empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator
from itertools import count
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import common, tokens

VOCABULARY_A = "/opt/tokenizers/byte_bpe_50k.json"
VOCABULARY_B = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters encoded and cut at a time.
BLOCK = 1_000_000
#: Pairs of ids (17 bytes each) up to which their table is sent to the tasks.
BROADCAST_PAIRS = 4_000_000

#: What ``aligned`` can return per document.
COLUMNS = {
    "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string",
    "a_ids": "array<int>", "b_ids": "array<int>", "a_ends": "array<int>", "b_ends": "array<int>",
    "pairs": "array<long>", "times": "array<int>",
}


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, reversed."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Tokenizers:
    """Both encoders, and the bytes of all their ids."""

    def __init__(self, vocabulary_a: bytes, vocabulary_b: bytes):
        import sentencepiece
        import tiktoken

        table = json.loads(vocabulary_a)
        special = {token["content"] for token in table["added_tokens"]}
        alphabet = byte_alphabet()
        ranks = {
            bytes(alphabet[c] for c in piece): number
            for piece, number in table["model"]["vocab"].items() if piece not in special
        }
        self.a = tiktoken.Encoding("a", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for piece, number in ranks.items():
            self.a_bytes[number] = piece
        self.b = sentencepiece.SentencePieceProcessor(model_proto=vocabulary_b)
        self.b_bytes = [
            bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i)
            else self.b.id_to_piece(i).replace("▁", " ").encode()
            for i in range(self.b.vocab_size())
        ]
        self.a_sizes = np.array([len(x) for x in self.a_bytes])
        self.b_sizes = np.array([len(x) for x in self.b_bytes])
        # How an id is written in a digest: inside its list, and as the last of its list.
        self.written = (
            [f"{i}{end}" for i in range(len(self.a_bytes)) for end in ",|"]
            + [f"{i}{end}" for i in range(len(self.b_bytes)) for end in ",;"]
        )

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A and B; None when there are none, or they do not give the bytes back."""
        if not text:
            return None
        data = b" " + text.encode()
        a, b = tokens.ordinary(self.a, " " + text), self.b.encode(text)
        if b"".join(map(self.a_bytes.__getitem__, a)) != data or b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


def group_ends(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int]]:
    """How many tokens of A and of B lie up to each end that both have."""
    at_a, at_b = dict(zip(ends_a, count(1))), dict(zip(ends_b, count(1)))
    common_ends = sorted(at_a.keys() & at_b.keys())
    return list(map(at_a.__getitem__, common_ends)), list(map(at_b.__getitem__, common_ends))


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the A and the B token of every link of one or more groups, in order.

    No token reaches over the end of a group, so all groups are expanded at once.
    """
    mark = np.zeros(int(ends_a[-1]) + 1 if len(ends_a) else 1, np.uint8)
    mark[ends_a] |= 1
    mark[ends_b] |= 2
    closed = mark[np.flatnonzero(mark)]
    is_a, is_b = closed & 1, closed >> 1
    return np.cumsum(is_a, dtype=np.int64) - is_a, np.cumsum(is_b, dtype=np.int64) - is_b


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def block_columns(texts: list[str | None], both: Tokenizers, wanted: tuple[str, ...]) -> dict[str, pa.Array]:
    """The wanted columns of ``COLUMNS`` for the texts of one block."""
    a_ids, b_ids, a_cuts, b_cuts, n = [], [], [], [], np.zeros((3, len(texts)), np.int64)
    for k, text in enumerate(texts):
        encoded = both.encode(text)
        if encoded is None:
            continue
        a, b = encoded
        cut_a, cut_b = group_ends(np.cumsum(both.a_sizes[a]).tolist(), np.cumsum(both.b_sizes[b]).tolist())
        a_ids.append(a), b_ids.append(b), a_cuts.append(cut_a), b_cuts.append(cut_b)
        n[:, k] = len(a), len(b), len(cut_a)
    n_a, n_b, n_groups = n
    none = [np.zeros(0, np.int64)]
    a, b = np.concatenate(a_ids or none), np.concatenate(b_ids or none)
    in_doc_a, in_doc_b = (np.concatenate([np.array(c, np.int64) for c in cuts] or none) for cuts in (a_cuts, b_cuts))
    end_a = in_doc_a + np.repeat(np.cumsum(n_a) - n_a, n_groups)
    end_b = in_doc_b + np.repeat(np.cumsum(n_b) - n_b, n_groups)
    n_links = n_a + n_b - n_groups
    out = {"n_a": pa.array(n_a), "n_b": pa.array(n_b), "n_groups": pa.array(n_groups), "n_links": pa.array(n_links)}
    if "groups_sha256" in wanted:
        start_a, start_b = (np.concatenate([[0], e[:-1]]) if len(e) else e for e in (end_a, end_b))
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[end_a - 1] = 1
        last_b[end_b - 1] = 1
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.repeat(start_b, end_a - start_a)] = 2 * a + last_a
        order[np.arange(len(b)) + np.repeat(end_a, end_b - start_b)] = 2 * (len(both.a_bytes) + b) + last_b
        stop = np.cumsum(n_a + n_b)
        out["groups_sha256"] = pa.array([
            hashlib.sha256("".join(map(both.written.__getitem__, order[e - s : e].tolist()))[:-1].encode()).hexdigest()
            if s else "" for e, s in zip(stop.tolist(), (n_a + n_b).tolist())
        ], pa.string())
    if "pairs" in wanted or "times" in wanted:
        link_a, link_b = links(np.cumsum(both.a_sizes[a]), np.cumsum(both.b_sizes[b]))
        size = len(both.b_bytes)
        most = len(both.a_bytes) * size
        keys = a[link_a] * size + b[link_b] + np.repeat(np.arange(len(texts)) * most, n_links)
        keys, times = np.unique(keys, return_counts=True)
        per_doc = np.bincount(keys // most, minlength=len(texts))
        out["pairs"] = _lists(keys % most, per_doc, pa.int64())
        out["times"] = _lists(times, per_doc, pa.int32())
    lists = {"a_ids": (a, n_a), "b_ids": (b, n_b), "a_ends": (in_doc_a, n_groups), "b_ends": (in_doc_b, n_groups)}
    out |= {c: _lists(*lists[c], pa.int32()) for c in wanted if c in lists}
    return {c: out[c] for c in wanted}


def blocks(texts: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes; a longer text is a range of its own."""
    start, held = 0, 0
    for i, size in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        if i > start and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if len(texts) > start:
        yield start, len(texts)


def aligned(
    docs: DataFrame, columns: tuple[str, ...] = ("a_ids", "b_ids", "a_ends", "b_ends"),
    key: str = "doc_id", text: str = "text",
    vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B,
) -> DataFrame:
    """Per row its key, a row number, and the chosen ``COLUMNS``.

    ``a_ends`` and ``b_ends`` say how many tokens of a document lie up to each group's end;
    ``pairs`` are its distinct links as A id x size of B + B id, ``times`` how often each occurs.
    The driver reads both vocabularies, files of fixed size, and sends them.
    """
    sent = docs.sparkSession.sparkContext.broadcast(
        (Path(vocabulary_a).read_bytes(), Path(vocabulary_b).read_bytes())
    )
    schema = ", ".join([f"`{key}` {docs.schema[key].dataType.simpleString()}", "row long", *[f"{c} {COLUMNS[c]}" for c in columns]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, row = Tokenizers(*sent.value), TaskContext.get().partitionId() << 36
        for batch in batches:
            for start, end in blocks(batch.column(1)):
                part = batch.slice(start, end - start)
                made = block_columns(part.column(1).to_pylist(), both, columns)
                numbers = pa.array(np.arange(row, row + len(part)))
                row += len(part)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), numbers, *made.values()], names=[key, "row", *made]
                )

    return docs.select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def pair_table(rows: DataFrame, size_b: int) -> DataFrame:
    """(pair, total, best): links of a pair in the corpus, and whether no pair of its B id has more."""
    counted = (
        rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
        .groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("total"))
    )
    of_b = Window.partitionBy(F.col("pair") % size_b)
    return counted.withColumn("best", F.col("total") == F.max("total").over(of_b))


def scored(rows: DataFrame, table: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Add ``n_best`` and ``count_sum`` to aligned rows, whose pairs are dropped."""
    if table.count() > broadcast_pairs:
        links_of = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(
            "row", F.col("x.pairs").alias("pair"), F.col("x.times").cast("long").alias("times")
        )
        sums = links_of.join(table, "pair").groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.col("times") * F.col("total")).alias("count_sum"),
        )
        return (
            rows.drop("pairs", "times").join(sums, "row", "left")
            .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")})
        )
    found = table.toArrow()
    pair, total, best = (found.column(c).to_numpy() for c in ("pair", "total", "best"))
    order = np.argsort(pair)
    sent = rows.sparkSession.sparkContext.broadcast((pair[order], total[order], best[order]))
    schema = rows.drop("pairs", "times").schema
    kept = list(schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, totals, bests = sent.value
        for batch in batches:
            lists, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
            at = np.searchsorted(known, lists.flatten().to_numpy())
            ends = np.cumsum(pc.list_value_length(lists).to_numpy())
            sums = [
                np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], ends])])
                for values in (times * bests[at], times * totals[at])
            ]
            rest = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays(
                [*rest, *[pa.array(s, pa.int64()) for s in sums]], names=[*kept, "n_best", "count_sum"]
            )

    return rows.mapInArrow(run, schema.add("n_best", "long").add("count_sum", "long"))


def op11(spark, sf) -> DataFrame:
    columns = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")
    rows = common.stage(aligned(common.documents(spark, sf), columns), "aligned")
    size_b = len(Tokenizers(Path(VOCABULARY_A).read_bytes(), Path(VOCABULARY_B).read_bytes()).b_bytes)
    table = common.stage(pair_table(rows, size_b), "pairs")
    return scored(rows, table).drop("row")


# Functions of this module travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
