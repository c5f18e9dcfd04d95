"""Operator 9: chat formatting by columnar byte assembly.

A turn becomes

    <turn ROLE>\\n TEXT </turn>\\n      (without the spaces)

with texts escaped so that no text can hold a mark: a backslash becomes two, `<turn ` becomes
`\\lturn ` and `</turn>` becomes `\\l/turn>`; in roles, `>` becomes `\\g` and a line feed `\\n`. Turns are
ordered by a range partitioning over (conversation, turn), so a long conversation is formatted by
several tasks. Each block of turns is assembled in columns: lengths of headers, contents and ends,
their running offsets, and scatter indices copy all bytes into one preallocated buffer, which Arrow
takes over as it is. A chunk is the part of one conversation in one block; its mask is the list of
byte ranges of assistant contents.

Defined cases: a null text or role counts as empty; a null conversation is one of its own; turns go
by (turn, role, text), nulls first; repeated rows are turns each; a conversation without assistant
turns has an empty mask; texts of any length are one turn, never cut; columns other than the four named
are not read, whatever their names; an empty table gives no chunks.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import parallelism
from tracelake.session import ship

OPEN, CLOSE, END = "<turn ", ">\n", "</turn>\n"
TRAINED = "assistant"
#: Bytes of content assembled at once, unless one turn has more.
BLOCK = 4 << 20
CHUNKS = "conv_id long, seq long, n_turns long, body binary, loss_from array<long>, loss_to array<long>"
_BACK = {b"\\\\": b"\\", b"\\l": b"<", b"\\g": b">", b"\\n": b"\n"}


def escaped(texts: pa.Array) -> pa.Array:
    """Contents in which neither mark can occur."""
    out = pc.replace_substring(texts, "\\", "\\\\")
    out = pc.replace_substring(out, "<turn ", "\\lturn ")
    return pc.replace_substring(out, "</turn>", "\\l/turn>")


def escaped_role(roles: pa.Array) -> pa.Array:
    out = pc.replace_substring(roles, "\\", "\\\\")
    return pc.replace_substring(pc.replace_substring(out, ">", "\\g"), "\n", "\\n")


def unescaped(raw: bytes) -> bytes:
    """What `escaped` or `escaped_role` was given."""
    return re.sub(rb"\\.", lambda m: _BACK[m[0]], raw, flags=re.DOTALL) if b"\\" in raw else raw


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a large string column, and its n + 1 offsets into them."""
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all turns, their n + 1 offsets, and where each turn's content starts and ends."""
    head, head_at = _bytes(pc.binary_join_element_wise(pa.scalar(OPEN, pa.large_string()), escaped_role(roles), pa.scalar(CLOSE, pa.large_string()), pa.scalar("", pa.large_string())))
    body, body_at = _bytes(escaped(texts))
    foot = np.frombuffer(END.encode(), np.uint8)
    n_head, n_body = np.diff(head_at), np.diff(body_at)
    at = np.r_[0, np.cumsum(n_head + n_body + len(foot))]
    starts = at[:-1] + n_head
    ends = starts + n_body
    out = np.empty(at[-1], np.uint8)
    out[np.repeat(at[:-1] - head_at[:-1], n_head) + np.arange(len(head))] = head
    out[np.repeat(starts - body_at[:-1], n_body) + np.arange(len(body))] = body
    out[(ends[:, None] + np.arange(len(foot))).ravel()] = np.tile(foot, len(ends))
    return out, at, starts, ends


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values, pa.int64()))


def _chunks(batches):
    task, seq = TaskContext.get().partitionId() << 40, 0
    for batch in batches:
        conv, role, text = batch.column(0), batch.column(1).cast(pa.large_string()), batch.column(2).cast(pa.large_string())
        filled = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(batch):
            before = filled[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(filled, before + BLOCK, side="right")))
            ids, own = conv.slice(at, end - at), role.slice(at, end - at)
            out, offsets, starts, ends = assemble(own, text.slice(at, end - at))
            key = ids.fill_null(0).to_numpy(zero_copy_only=False)
            gone = ids.is_null().to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (gone[1:] != gone[:-1])])
            sizes = np.diff(np.r_[first, len(key)])
            chunk = np.repeat(np.arange(len(first)), sizes)
            trained = pc.equal(own, TRAINED).to_numpy(zero_copy_only=False).astype(bool)
            base = offsets[first][chunk]
            masks = np.bincount(chunk[trained], minlength=len(first))
            cuts = np.r_[offsets[first], offsets[-1]].astype(np.int32)
            body = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(cuts), pa.py_buffer(out)])
            columns = [ids.take(pa.array(first)), pa.array(task + seq + np.arange(len(first))), pa.array(sizes.astype(np.int64)), body, _lists((starts - base)[trained], masks), _lists((ends - base)[trained], masks)]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "seq", "n_turns", "body", "loss_from", "loss_to"])
            seq += len(first)
            at = end


def format_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Chunks (conv_id, seq, n_turns, body, loss_from, loss_to): a conversation is its bodies by seq."""
    ship(turns.sparkSession)
    empty = F.lit("")
    rows = turns.select(F.col(f"`{conv}`").cast("long").alias("conv_id"), F.coalesce(F.col(f"`{role}`").cast("string"), empty).alias("role"), F.coalesce(F.col(f"`{text}`").cast("string"), empty).alias("text"), F.col(f"`{turn}`").alias("turn"))
    # Turns of equal place and role stay together, so the text orders them within a partition.
    sorted_ = rows.repartitionByRange(parallelism(turns.sparkSession), "conv_id", "turn", "role").sortWithinPartitions("conv_id", "turn", "role", "text")
    return sorted_.select("conv_id", "role", "text").mapInArrow(_chunks, CHUNKS)


def parse(body: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of every turn of a chunk, unescaped."""
    out, at, end_mark = [], 0, END.encode()
    while at < len(body):
        if not body.startswith(OPEN.encode(), at):
            raise ValueError(f"no turn at byte {at}")
        close = body.index(CLOSE.encode(), at)
        end = body.index(end_mark, close + 2)
        out.append((unescaped(body[at + len(OPEN) : close]), unescaped(body[close + 2 : end])))
        at = end + len(end_mark)
    return out


def _read(batches):
    names = ["conv_id", "seq", "n_turns", "turns", "loss", "formatted_chars"]
    for batch in batches:
        ids, seqs, _, bodies, froms, tos = (c for c in batch.columns)
        n, turns, loss, chars = [], [], [], []
        for body, a, b in zip(bodies, froms.to_pylist(), tos.to_pylist()):
            raw = body.as_py()
            parts = parse(raw)
            n.append(len(parts))
            turns.append(b"".join(x for r, t in parts for x in (r, b"\n", t, b"\n")))
            loss.append(b"".join(unescaped(raw[x:y]) for x, y in zip(a, b)))
            chars.append(len(raw.decode()))
        yield pa.RecordBatch.from_arrays([ids, seqs, pa.array(n, pa.int64()), pa.array(turns, pa.binary()), pa.array(loss, pa.binary()), pa.array(chars, pa.int64())], names)


def _digests(batches):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    now, state = None, None
    for batch in batches:
        out = []
        for conv, n, turns, loss, chars in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5))):
            if state is None or conv != now:
                if state is not None:
                    out.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[0] += n
            state[1].update(turns)
            state[2] += len(loss.decode())
            state[3].update(loss)
            state[4] += chars
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names)
    if state is not None:
        last = (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(last, kinds)], names)


def digests(chunks: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back: turns and masked texts, as digests.

    Chunks are parsed where they are; only their texts meet, conversation by conversation, and are
    digested as they stream by.
    """
    read = chunks.mapInArrow(_read, "conv_id long, seq long, n_turns long, turns binary, loss binary, formatted_chars long")
    met = read.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return met.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
