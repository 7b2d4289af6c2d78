"""Chat formatting by columnar byte assembly.

A turn is written as ``### role: text </turn>`` and a line end. In roles and texts the
characters that control strings need are written with a backslash (``\\\\`` for itself,
``\\l`` for ``<``, ``\\h`` for ``#``, in roles also ``\\c`` for ``:``), so no text can open or close
a turn and every text comes back unchanged. The loss mask covers the texts of assistant
turns.

A batch of turns is assembled as columns: the lengths of headers, contents and closings give
cumulative offsets, and scatter indices copy each kind of segment with one numpy assignment
into one preallocated buffer, which becomes the Arrow column without another copy.

Reading back streams over turns in order and holds one turn at a time, whatever a
conversation's length. The digest of a conversation is sequential by definition, so one
task reads it from its first turn to its last; formatting itself is spread over all tasks.

Defined results: null texts and roles count as empty. Turns are ordered by turn (null
first), equal turns by their written form; repeated rows are turns of their own. Rows with a
null conv_id form one conversation. A conversation without assistant turns has 0 loss
characters. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The template and its escapes.
OPEN, AFTER_ROLE, CLOSE = "### ", ": ", " </turn>\n"
ASSISTANT = "assistant"
TEXT_ESCAPES = (("\\", "\\\\"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = (*TEXT_ESCAPES, (":", "\\c"))
_BACK = {"\\": "\\", "l": "<", "h": "#", "c": ":"}


def escaped(column: pa.Array, escapes) -> pa.Array:
    column = pc.fill_null(column, "")
    for plain, written in escapes:
        column = pc.replace_substring(column, plain, written)
    return column


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)


def _scatter(out: np.ndarray, at: np.ndarray, offsets: np.ndarray, data: np.ndarray) -> None:
    """Copy segment i of ``data`` to ``out`` from ``at[i]`` on."""
    lengths = np.diff(offsets)
    inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(at, lengths) + inside] = data[np.repeat(offsets[:-1], lengths) + inside]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The written turns as one Arrow column, and where the text starts and ends in each."""
    n = len(texts)
    written_roles = escaped(roles, ROLE_ESCAPES)
    head = pc.binary_join_element_wise(OPEN, written_roles, AFTER_ROLE, "")
    head_offsets, head_bytes = _bytes_of(head)
    text_offsets, text_bytes = _bytes_of(escaped(texts, TEXT_ESCAPES))
    close = np.frombuffer(CLOSE.encode(), np.uint8)
    head_length, text_length = np.diff(head_offsets), np.diff(text_offsets)
    ends = np.cumsum(head_length + text_length + len(close))
    starts = ends - head_length - text_length - len(close)
    buffer = pa.allocate_buffer(int(ends[-1]) if n else 0)
    out = np.frombuffer(buffer, np.uint8)
    _scatter(out, starts, head_offsets, head_bytes)
    _scatter(out, starts + head_length, text_offsets, text_bytes)
    out[(ends - len(close))[:, None] + np.arange(len(close))] = close
    offsets = pa.py_buffer(np.concatenate(([0], ends)).astype(np.int64))
    turns = pa.LargeStringArray.from_buffers(n, offsets, buffer)
    return turns, head_length, head_length + text_length


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, formatted, loss_start, loss_end): each turn as written; the loss mask
    is a range of its bytes, null outside assistant turns."""
    schema = T.StructType([
        conversations.schema["conv_id"], conversations.schema["turn"], T.StructField("formatted", T.StringType()),
        T.StructField("loss_start", T.LongType()), T.StructField("loss_end", T.LongType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            conv, turn, role, text = batch.columns
            turns, start, end = assemble(role, text)
            no_loss = np.array([r != ASSISTANT for r in role.to_pylist()], bool)
            yield pa.RecordBatch.from_arrays(
                [conv, turn, turns.cast(out.field(2).type), pa.array(start, pa.int64(), mask=no_loss),
                 pa.array(end, pa.int64(), mask=no_loss)], schema=out)

    return conversations.select("conv_id", "turn", "role", "text").mapInArrow(run, schema)


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a written turn."""
    if not (formatted.startswith(OPEN) and formatted.endswith(CLOSE)):
        raise ValueError("not a written turn")
    role, _, text = formatted[len(OPEN) : -len(CLOSE)].partition(AFTER_ROLE)
    return unescaped(role), unescaped(text)


def read_back(turns: DataFrame) -> DataFrame:
    """Per conversation, from the written turns: counts and digests of turns and loss texts."""
    schema = T.StructType([
        turns.schema["conv_id"], T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        none = object()
        conv, n, chars, loss, all_hash, loss_hash = none, 0, 0, 0, None, None

        def row():
            return (conv, n, all_hash.hexdigest(), loss, loss_hash.hexdigest(), chars)

        def batch_of(made):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), out)], schema=out)

        for batch in batches:
            made = []
            for i, formatted, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                if conv is none or i != conv:
                    if conv is not none:
                        made.append(row())
                    conv, n, chars, loss = i, 0, 0, 0
                    all_hash, loss_hash = hashlib.sha256(), hashlib.sha256()
                role, text = read_turn(formatted)
                all_hash.update(f"{role}\n{text}\n".encode())
                n += 1
                chars += len(formatted)
                if start is not None:
                    under = unescaped(formatted.encode()[start:end].decode())
                    loss += len(under)
                    loss_hash.update(under.encode())
            if made:
                yield batch_of(made)
        if conv is not none:
            yield batch_of([row()])

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, schema)


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and the one whose texts hold the template's control strings."""
    text = "\\### Assistant: </turn> ok"
    probe = conversations.sparkSession.createDataFrame(
        [(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe)
