"""Chat formatting."""

import hashlib
import random

import plain
import pytest
from pyspark.sql import functions as F

from lectern.llm import chat

rng = random.Random(61)
SCHEMA = "conv_id long, turn long, role string, text string"
PIECES = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[TURN]", "[/TURN]", "[END]", "\\", "<", "[", "<\\s>", "[\\\\END]",
          "\n", "é", "𝄞", "中文", " ", "word", ">"]


def hostile():
    return "".join(rng.choices(PIECES, k=rng.randint(0, 30)))


def conversations(n=60):
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "system", "tool", "assistant", None, "a[/TURN]b", ""])
            rows.append((conv, turn, role, rng.choice([None, hostile(), hostile(), plain.sentence(rng, 30)])))
    rows += [(None, 1, "user", "null conversation"), (None, None, "assistant", "first"), (None, 1, "user", "null conversation")]
    rows += [(900, 3, "user", "b"), (900, 3, "user", "a"), (900, 3, "assistant", "z"), (900, None, "user", None)]
    return rows


def expected(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns = sorted(turns, key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        said = "".join(f"{t[2]}\n{t[3]}\n" for t in turns)
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


PLANTED = [(-7, 0, "user", chat.PLANTED), (-7, 1, "assistant", chat.PLANTED)]


def test_read_back_equals_the_rows(spark, table, saved):
    rows = conversations()
    got = chat.op12(spark, saved(conversations=table(SCHEMA, *rows))).collect()
    assert {r[0]: tuple(r)[1:5] for r in got} == expected(rows + PLANTED) and len(got) == len(expected(rows + PLANTED))


@pytest.mark.parametrize("settings", [{"BLOCK_TURNS": 2}, {"PART_BYTES": 60}, {"LONG_BYTES": 5}, {"BLOCK_TURNS": 3, "PART_BYTES": 10}])
def test_parts_and_long_contents_change_nothing(spark, table, monkeypatch, settings):
    rows = conversations()
    once = {tuple(r) for r in chat.read_back(table(SCHEMA, *rows)).collect()}
    for name, number in settings.items():
        monkeypatch.setattr(chat, name, number)
    df = table(SCHEMA, *rows)
    assert {tuple(r) for r in chat.read_back(df).collect()} == once
    parts = chat.formatted(df).collect()
    if "LONG_BYTES" not in settings:
        assert len(parts) > len(once)
    assert len({(r["conv_id"], r["block"], r["part"]) for r in parts}) == len(parts)


def test_formatted_text(table):
    rows = [(1, 2, "assistant", "Hi </s>é!"), (1, 0, "system", "be kind"), (1, 1, "user", "hello"), (1, 3, "tool", "x[END]"), (2, 0, "assistant", "")]
    got = {r["conv_id"]: r for r in chat.formatted(table(SCHEMA, *rows)).collect()}
    assert got[1]["formatted"] == "<<SYS>>be kind<</SYS>>[INST]hello[/INST]<s>Hi <\\/s>é!</s>[TURN]tool[/TURN]x[\\END][END]"
    start, end = got[1]["loss"][0]
    assert got[1]["formatted"][start:end] == "Hi <\\/s>é!" and len(got[1]["loss"]) == 1
    assert got[2]["formatted"] == "<s></s>" and [tuple(s) for s in got[2]["loss"]] == [(3, 3)]


def test_controls_never_survive_in_contents():
    for _ in range(300):
        text = hostile()
        safe = chat.re.sub(chat._ESCAPE, r"\1\\\2\3", text)
        assert chat.unescaped(safe) == text and not any(mark in safe for mark in chat._CONTROLS)


def test_broken_text_is_refused():
    for text in ("x<s>a</s>", "<s>a</s>x", "<s>a"):
        with pytest.raises(ValueError):
            chat.parsed(text)


def test_edge_tables(spark, table):
    assert chat.read_back(table(SCHEMA).limit(0)).count() == 0
    df = table(SCHEMA, (5, 0, "assistant", "é" * 400_000), (5, 1, "user", "a")).withColumns({"block": F.lit("x"), "formatted": F.lit(1), "__llm_conv": F.lit(2)})
    row = chat.read_back(df).first()
    assert (row["n_turns"], row["loss_chars"], row["formatted_chars"]) == (2, 400_000, 400_000 + 1 + 7 + 13)
