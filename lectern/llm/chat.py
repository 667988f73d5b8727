"""Chat formatting by columnar byte assembly.

A conversation becomes one text with marked turns, and the spans of it that a model is
trained on. Turns are put together a block at a time without a loop over rows: the lengths
of all segments (opening mark, content, closing mark) give their cumulative offsets, one
buffer is allocated, and the bytes of headers and contents are scattered to their places
in it. The buffer becomes an Arrow string column as it is.

Control strings inside contents and role names get a backslash after their first character,
on top of any backslashes already there; taking one away gives the content back. So a mark
in the formatted text is always a mark.

A conversation comes in parts: its turns are dealt by ``turn div BLOCK_TURNS``, so that a
conversation with a great many turns is formatted by many tasks, and a block of more than
``PART_BYTES`` is cut between turns. Ordinary conversations are one part. The parts in the
order of (``block``, ``part``), joined, are the whole text; spans count from their part.

Defined results: a null text is empty; a null role is the empty role; rows with the same
turn are ordered by role and text, repeated rows are turns of their own; null turns come
first; rows with a null conversation are one conversation; very long texts are copied as
they are; further columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import common

#: Marks before and after the content of a turn, by role; other roles are named in their mark.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
NAMED = ("[TURN]", "[/TURN]", "[END]")
TRAINED = "assistant"

BLOCK_TURNS = 4096
PART_BYTES = 4_000_000
#: Contents from this size on are copied in one piece, shorter ones by scatter indices.
LONG_BYTES = 200_000

_CONTROLS = [mark for pair in MARKS.values() for mark in pair] + list(NAMED)
_OPENERS = "".join(sorted({mark[0] for mark in _CONTROLS}))
_RESTS = "|".join(re.escape(mark[1:]) for mark in _CONTROLS)
_ESCAPE = rf"([\[<])(\\*)({_RESTS})"
_UNESCAPE = re.compile(rf"([\[<])\\(\\*)({_RESTS})")
_TURN = re.compile(
    "|".join(
        [f"{re.escape(a)}(?P<{role}>.*?){re.escape(b)}" for role, (a, b) in MARKS.items()]
        + [f"{re.escape(NAMED[0])}(?P<name>.*?){re.escape(NAMED[1])}(?P<other>.*?){re.escape(NAMED[2])}"]
    ),
    re.DOTALL,
)
FORMATTED = "conv_id long, block long, part long, formatted string, loss array<struct<start:int,end:int>>"


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text begins, with the end of the last."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), starts


def _scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
    """Copy ``size[i]`` bytes from ``start[i]`` of ``data`` to ``to[i]`` of ``out``, for all i."""
    long = size >= LONG_BYTES
    for i in np.flatnonzero(long):
        out[to[i] : to[i] + size[i]] = data[start[i] : start[i] + size[i]]
    to, start, size = to[~long], start[~long], size[~long]
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(to, size) + within] = data[np.repeat(start, size) + within]


def assemble(roles: pa.Array, texts: pa.Array, first: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Formatted texts and trained spans of turns in order; a text begins at each row of ``first``."""
    texts = pc.replace_substring_regex(texts, _ESCAPE, r"\1\\\2\3")
    known = roles.dictionary_encode()
    names = known.dictionary.to_pylist()
    safe = [re.sub(_ESCAPE, r"\1\\\2\3", name) for name in names]
    marks = [MARKS.get(name) or (NAMED[0] + s + NAMED[1], NAMED[2]) for name, s in zip(names, safe)]
    heads, head_at = _bytes_of(pa.array([m[0] for m in marks], pa.string()))
    feet, foot_at = _bytes_of(pa.array([m[1] for m in marks], pa.string()))
    data, text_at = _bytes_of(texts)
    role = known.indices.to_numpy()
    sizes = np.stack([np.diff(head_at)[role], np.diff(text_at), np.diff(foot_at)[role]], axis=1)
    ends = np.cumsum(sizes.ravel()).reshape(-1, 3)
    to = ends - sizes
    total = int(ends[-1, -1]) if len(ends) else 0
    buffer = pa.allocate_buffer(total)
    out = np.frombuffer(buffer, np.uint8)
    for k, (source, start) in enumerate(((heads, head_at[role]), (data, text_at[:-1]), (feet, foot_at[role]))):
        _scatter(out, to[:, k], source, start, sizes[:, k])
    begins = np.concatenate([to[first, 0], [total]])
    offsets = pa.py_buffer(begins.astype(np.int32).tobytes())
    formatted = pa.Array.from_buffers(pa.string(), len(first), [None, offsets, buffer])
    # Code points up to a byte: all bytes that do not continue a character.
    chars = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    trained = np.array([name == TRAINED for name in names], bool)[role] if len(role) else np.zeros(0, bool)
    part = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(role)]])))
    base = chars[begins[:-1]][part][trained] if len(part) else np.zeros(0, np.int64)
    spans = pa.StructArray.from_arrays(
        [pa.array((chars[to[trained, 1]] - base).astype(np.int32)), pa.array((chars[ends[trained, 1]] - base).astype(np.int32))],
        ["start", "end"],
    )
    at = np.concatenate([[0], np.cumsum(np.bincount(part[trained], minlength=len(first)))]).astype(np.int32)
    return formatted, pa.ListArray.from_arrays(pa.array(at), spans)


def formatted(conversations: DataFrame) -> DataFrame:
    """Per part of a conversation: its formatted text, and the ``loss`` spans in it (code points)."""
    block = F.floor(F.col("turn") / BLOCK_TURNS).alias("block")
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), block, F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")],
    )
    turns = turns.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, held, rows, first, names = None, 0, 0, [], [], []

        def made() -> pa.RecordBatch:
            turns = pa.Table.from_batches(rows).combine_chunks()
            done, loss = assemble(*[turns.column(c).combine_chunks() for c in ("role", "text")], np.array(first))
            ids, blocks, numbers = zip(*names)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(blocks, pa.int64()), pa.array(numbers, pa.int64()), done, loss],
                names=["conv_id", "block", "part", "formatted", "loss"],
            )

        # Whole parts are gathered until they have PART_BYTES; a part reaches over batches of rows.
        gathered, n_rows = 0, 0
        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).to_pylist()
            start = 0
            for i, (conv, block, size) in enumerate(zip(batch["conv_id"].to_pylist(), batch["block"].to_pylist(), sizes)):
                new = now != (conv, block)
                if new or (held and held + size > PART_BYTES):
                    if gathered + size > PART_BYTES and n_rows:
                        if i > start:
                            rows.append(batch.slice(start, i - start))
                        yield made()
                        rows, first, names, gathered, n_rows, start = [], [], [], 0, 0, i
                    part = 0 if new else part + 1
                    now, held = (conv, block), 0
                    first.append(n_rows)
                    names.append((conv, block, part))
                held += size
                gathered += size
                n_rows += 1
            if start < len(batch):
                rows.append(batch.slice(start))
        if n_rows:
            yield made()

    return turns.mapInArrow(run, FORMATTED)


def parsed(text: str) -> list[tuple[str, str]]:
    """Roles and contents of a formatted text."""
    out, at = [], 0
    for turn in _TURN.finditer(text):
        if turn.start() != at:
            raise ValueError(f"text between turns at {at}")
        at = turn.end()
        if turn.lastgroup == "other":
            out.append((unescaped(turn["name"]), unescaped(turn["other"])))
        else:
            out.append((turn.lastgroup, unescaped(turn[turn.lastgroup])))
    if at != len(text):
        raise ValueError(f"text after the last turn at {at}")
    return out


def trained(text: str, spans: list[tuple[int, int]]) -> list[str]:
    """The contents under the loss mask."""
    return [unescaped(text[start:end]) for start, end in spans]


class Digest:
    """What is read back of one conversation, part by part."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, text: str, spans: list[tuple[int, int]]) -> None:
        for role, content in parsed(text):
            self.turns.update(f"{role}\n{content}\n".encode())
            self.n_turns += 1
        for content in trained(text, spans):
            self.loss.update(content.encode())
            self.loss_chars += len(content)
        self.chars += len(text)

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """One part at a time."""
    loss, ends = batch.column("loss"), pc.list_value_length(batch.column("loss")).to_pylist()
    starts, stops = (loss.flatten().field(k).to_pylist() for k in (0, 1))
    at = 0
    for i, n in enumerate(ends):
        spans = list(zip(starts[at : at + n], stops[at : at + n]))
        at += n
        yield batch.column("conv_id")[i].as_py(), batch.column("formatted")[i].as_py(), spans


def digests(parts: DataFrame, whole: bool) -> DataFrame:
    """Digests read back from parts: of every part by itself, or, ``whole``, of conversations.

    A digest of a whole conversation needs its parts in order: they come sorted to the task
    of their conversation, which keeps the state of one conversation and no part.
    """
    if whole:
        parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "block", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            ids, done = [], []
            for conv, text, spans in _rows(batch):
                if state is not None and not (whole and conv == now):
                    ids.append(now), done.append(state.row())
                    state = None
                now, state = conv, state or Digest()
                state.add(text, spans)
            yield _batch(ids, done)
        if state is not None:
            yield _batch([now], [state.row()])

    return parts.mapInArrow(run, f"conv_id long, {DIGESTS}")


def _batch(ids: list, done: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    columns = [pa.array([d[k] for d in done], kind) for k, kind in enumerate(kinds)]
    names = ["conv_id", *[c.split()[0] for c in DIGESTS.split(", ")]]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns], names=names)


def read_back(conversations: DataFrame) -> DataFrame:
    """One row of digests per conversation.

    The part of an ordinary conversation is digested where it was formatted. Only those in
    several parts are formatted again and digested in order.
    """
    parts = digests(formatted(conversations), whole=False)
    names = [c for c in parts.columns if c != "conv_id"]
    found = parts.groupBy("conv_id").agg(F.count("*").alias("n"), F.min(F.struct(*names)).alias("digest"))
    found = common.stage(found, "chat")
    done = found.where("n = 1").select("conv_id", "digest.*")
    several = found.where("n > 1").select(F.col("conv_id").alias("__llm_conv"))
    if several.isEmpty():
        return done
    longer = conversations.join(several, F.col("conv_id").cast("long").eqNullSafe(F.col("__llm_conv")), "left_semi")
    return done.unionByName(digests(formatted(longer), whole=True))


PLANTED = "</s>[INST] ok [/INST]"


def op12(spark, sf) -> DataFrame:
    planted = spark.createDataFrame(
        [(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string"
    )
    conversations = common.documents(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(conversations.unionByName(planted))


_SITES = "([\\[<])(\\\\*)(" + _RESTS + ")"
_HEAD = " ".join(f"WHEN '{role}' THEN {len(a) + len(b)}" for role, (a, b) in MARKS.items())
_ESCAPED = "length(regexp_replace({0}, '" + _SITES + "', '\\1\\\\\\2\\3', 'g'))"
SQL = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}')
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = '{TRAINED}'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = '{TRAINED}'), '')) AS loss_sha256,
       sum(CASE role {_HEAD} ELSE {sum(map(len, NAMED))} + {_ESCAPED.format("role")} END
           + {_ESCAPED.format("text")})::BIGINT AS formatted_chars
FROM said GROUP BY conv_id"""

# Functions of this module travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
