import hashlib
import random

import pyarrow as pa
import pytest

from broodline.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, extra string"
CONTROL = "\\### Assistant: </turn> ok"


def want(rows):
    """Digests of a conversation's (role, text) turns in order."""
    rows = [(r or "", t or "") for r, t in rows]
    loss = "".join(t for r, t in rows if r == "assistant")
    return (len(rows), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in rows).encode()).hexdigest(), len(loss),
            hashlib.sha256(loss.encode()).hexdigest())


CONVERSATIONS = {
    1: [("user", "hi"), ("assistant", "hello é😀")], 2: [("system", None), (None, "x"), ("assistant", None)],
    3: [("user", CONTROL), ("assistant", CONTROL)], 4: [("ass: istant#", "a"), ("Assistant", "\\l\\h\\\\<#")],
    5: [("assistant", "line\nline </turn>\n### user: x")], None: [("user", "no id")],
    6: [(["user", "assistant"][i % 2], f"{i} " + "y" * (i % 97)) for i in range(3000)], 7: [("assistant", "z" * 100_000)],
}


@pytest.fixture(scope="module")
def rows():
    out = [(c, k, r, t, "?") for c, turns in CONVERSATIONS.items() for k, (r, t) in enumerate(turns)]
    random.Random(1).shuffle(out)
    return out


def test_round_trip(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    turns = chat.format_turns(df)
    got = {r.conv_id: r for r in chat.read_back(turns).collect()}
    assert got.keys() == CONVERSATIONS.keys()
    for c, conversation in CONVERSATIONS.items():
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == want(conversation)
    assert sum(r.formatted_chars for r in got.values()) == sum(len(r.formatted) for r in turns.collect())


def test_no_text_opens_or_closes_a_turn(spark, rows):
    for r in chat.format_turns(spark.createDataFrame(rows, SCHEMA)).collect():
        assert r.formatted.count(chat.OPEN) == 1 and r.formatted.count(chat.CLOSE) == 1
        if r.loss_start is not None:
            assert r.formatted.encode()[r.loss_end :].decode() == chat.CLOSE


def test_equal_turns_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", ""), (1, 0, "user", "a", ""), (1, None, "user", "b", "")], SCHEMA)
    r = chat.read_back(chat.format_turns(df)).first()
    assert (r.n_turns, r.turns_sha256) == want([("user", "b"), ("user", "a"), ("user", "a")])[:2]
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_probe(spark):
    df = spark.createDataFrame([], SCHEMA)
    r = chat.read_back(chat.format_turns(chat.with_probe(df))).first()
    assert r.conv_id == -7 and tuple(r)[1:5] == want([("user", CONTROL), ("assistant", CONTROL)])


def test_slices_of_columns():
    roles, texts = pa.array(["x", "user", "assistant"])[1:], pa.array(["zz", "é", "b"])[1:]
    turns, start, end = chat.assemble(roles, texts)
    assert turns.to_pylist() == ["### user: é </turn>\n", "### assistant: b </turn>\n"]
    assert [t.encode()[a:b].decode() for t, a, b in zip(turns.to_pylist(), start, end)] == ["é", "b"]
    assert len(chat.assemble(pa.array([], pa.string()), pa.array([], pa.string()))[0]) == 0
