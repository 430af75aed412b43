"""Operator 8: exact round trips and the state machine."""

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import chat_format as cf

NASTY = ["", "\\", "\\\\", "\\h", "###", "####", "</turn>", "<</turn>\n", "\\</turn>", "### Assistant: x", "a\n\\l/turn>", "é😀", "\\### Assistant: </turn> ok", ": :"]


def chats(spark, rows):
    df = spark.createDataFrame([(*r, "f") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    return cf.format_conversations(df).select("*", cf.read_turns(F.col("formatted")).alias("turns"), cf.read_loss_text(F.col("segments")).alias("loss"))


def test_round_trip(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", a + b) for c, a in enumerate(NASTY) for t, b in enumerate(NASTY)]
    rows += [(100, 0, "od:d### role", "x"), (101, 0, None, None)]
    for r in chats(spark, rows).collect():
        own = sorted((x for x in rows if x[0] == r["conv_id"]), key=lambda x: x[1])
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2] or "", x[3] or "") for x in own]
        assert r["loss"] == "".join(x[3] for x in own if x[2] == "assistant")
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]


@pytest.mark.parametrize(
    ("roles", "valid", "complete"),
    [("user assistant", True, True), ("system user assistant user", True, False), ("assistant", False, False), ("user user assistant", False, False), ("user system", False, False), ("user tool", False, False)],
)
def test_machine(spark, roles, valid, complete):
    rows = [(1, n, r, "t") for n, r in enumerate(roles.split())]
    got = chats(spark, rows).first()
    assert (got["valid"], got["complete"]) == (valid, complete)


def test_ties_and_repeats_and_empty(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "system", "s"), (1, 0, "user", "a"), (None, 0, "user", "n")]
    got = {r["conv_id"]: [t["text"] for t in r["turns"]] for r in chats(spark, rows).collect()}
    assert got == {1: ["s", "a", "a", "b"], None: ["n"]}
    assert chats(spark, []).count() == 0


def test_long_texts_and_ties(spark):
    """A text of 300,000 characters with marks throughout; turns of one number; clashing names."""
    long = "### a: </turn>\\ " * 20_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (None, None, None, None)]
    turns = spark.createDataFrame([(*r, "x", True) for r in rows], "conv_id long, turn int, role string, text string, formatted string, segments boolean")
    stored = cf.format_conversations(turns)
    got = {r["conv_id"]: r for r in stored.select("conv_id", "valid", "complete", cf.read_turns(F.col("formatted")).alias("turns"), cf.read_loss_text(F.col("segments")).alias("loss")).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("user", long), ("assistant", long), ("assistant", "b"), ("assistant", "b")]
    assert got[1]["loss"] == long + "bb"
    assert not got[1]["valid"]
    assert [(t["role"], t["text"]) for t in got[None]["turns"]] == [("", "")]
