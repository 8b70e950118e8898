"""Chat formatting by columnar byte assembly.

Every turn is ``### role: text </turn>\\n``. Inside texts ``\\`` becomes ``\\\\``, ``###`` becomes
``\\#\\#\\#`` and ``</turn>`` becomes ``\\</turn>``; a marker's ``<`` follows a space, an escaped one
a backslash, so reading back needs no guess. For a batch of turns numpy computes the lengths of all segments
(mark, role, separator, text, end), their cumulative offsets and the scatter index, and copies
constants and column bytes into one preallocated buffer, which becomes the Arrow column as it is.

Turns are range-partitioned by conversation and turn, so a conversation with very many turns is
formatted by several tasks; each task emits a conversation as one part, or in parts of about
``PART_BYTES``. A part has the text and the loss spans (bytes of each assistant text in it). Reading back
streams the parts of a conversation in order with constant memory.

Defined results: a null text or role is empty; turns that tie are ordered by role, then text; a null turn
comes first; rows of a null conv_id form one conversation; repeated rows are turns of their own;
an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.blocks import map_arrow

MARK, SEPARATOR, END = b"### ", b": ", b" </turn>\n"
TRAINED_ROLE = "assistant"
PART_BYTES = 8 << 20

_PART = "conv_id long, first_turn long, part long, n_turns long, text string, loss array<struct<start:int,end:int>>"
_LOSS_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def escape(texts: pa.Array) -> pa.Array:
    out = pc.replace_substring(texts, "\\", "\\\\")
    out = pc.replace_substring(out, "###", "\\#\\#\\#")
    return pc.replace_substring(out, "</turn>", "\\</turn>")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)), offsets


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all formatted turns: bytes, turn offsets, text starts and text ends."""
    n = len(texts)
    role_bytes, role_at = _bytes_of(pc.replace_substring(escape(roles.fill_null("")), ":", "\\:"))
    text_bytes, text_at = _bytes_of(escape(texts.fill_null("")))
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0], lengths[:, 2], lengths[:, 4] = len(MARK), len(SEPARATOR), len(END)
    lengths[:, 1], lengths[:, 3] = np.diff(role_at), np.diff(text_at)
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    starts = ends - lengths
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for column, constant in ((0, MARK), (2, SEPARATOR), (4, END)):
        out[starts[:, column, None] + np.arange(len(constant))] = np.frombuffer(constant, np.uint8)
    for column, (data, at) in ((1, (role_bytes, role_at)), (3, (text_bytes, text_at))):
        size = lengths[:, column]
        shift = np.repeat(starts[:, column] - (at[:-1] - at[0]), size)
        out[shift + np.arange(int(size.sum()))] = data[at[0] : at[-1]]
    return out, np.concatenate([[0], ends[:, 4]]) if n else np.zeros(1, np.int64), starts[:, 3], ends[:, 3]


def _parts(rows: pa.Table | pa.RecordBatch, numbers: list[int], cuts: np.ndarray) -> pa.RecordBatch:
    """Format the rows; ``cuts`` are the row offsets of the parts, ``numbers`` their numbers."""
    data, turn_at, text_s, text_e = assemble(rows.column("role"), rows.column("text"))
    offsets = turn_at[cuts]
    texts = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
    trained = np.flatnonzero(np.array([r == TRAINED_ROLE for r in rows.column("role").to_pylist()], bool)) if rows.num_rows else np.zeros(0, np.int64)
    part = np.searchsorted(cuts, trained, side="right") - 1
    spans = pa.StructArray.from_arrays([pa.array((text_s[trained] - offsets[part]).astype(np.int32)), pa.array((text_e[trained] - offsets[part]).astype(np.int32))], names=["start", "end"])
    loss = pa.ListArray.from_arrays(pa.array(np.searchsorted(trained, cuts).astype(np.int32)), spans)
    heads = pa.array(cuts[:-1])
    return pa.RecordBatch.from_arrays([
        rows.column("conv_id").take(heads), rows.column("turn").take(heads), pa.array(numbers, pa.int64()), pa.array(np.diff(cuts).astype(np.int64)), texts, loss.cast(_LOSS_TYPE),
    ], names=["conv_id", "first_turn", "part", "n_turns", "text", "loss"])


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, first_turn, part, n_turns, text and loss spans (bytes) of all conversations."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    dealt = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last conversation may go on in the next batch
        number = 0
        for batch in batches:
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches(max_chunksize=None)[0]
            ids = rows.column("conv_id")
            new = pc.not_equal(ids.slice(1).fill_null(-(2**62)), ids.slice(0, len(ids) - 1).fill_null(-(2**62))).to_numpy(zero_copy_only=False)
            bounds = [0, *(np.flatnonzero(new) + 1).tolist()]
            written = [pc.fill_null(pc.binary_length(rows.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("role", "text")]
            sizes = np.concatenate([[0], np.cumsum(sum(written) + len(MARK + SEPARATOR + END))])
            # whole conversations, and parts of PART_BYTES (roles and marks count) of one that is larger
            cuts = [0]
            for a, b in zip(bounds, [*bounds[1:], len(ids)], strict=True):
                at = a
                while sizes[b] - sizes[at] > PART_BYTES:
                    at = min(max(at + 1, int(np.searchsorted(sizes, sizes[at] + PART_BYTES))), b)
                    cuts.append(at)
                if b < len(ids) and cuts[-1] != b:
                    cuts.append(b)
            if cuts[-1] > 0:
                yield _parts(rows.slice(0, cuts[-1]), list(range(number, number + len(cuts) - 1)), np.array(cuts))
                number += len(cuts) - 1
            held = rows.slice(cuts[-1]) if cuts[-1] < len(ids) else None
        if held is not None and held.num_rows:
            yield _parts(held, [number], np.array([0, held.num_rows]))

    return map_arrow(dealt, run, _PART)


_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): (.*?) </turn>\n", re.DOTALL)


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a formatted part."""
    return ((unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(text))


def read_back(parts: DataFrame) -> DataFrame:
    """One row per conversation: digests of its turns and of its unescaped loss text, read from the parts."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [c.split()[0] for c in schema.split(", ")]
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "first_turn", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        done: list[tuple] = []

        def close() -> None:
            if state is not None:
                done.append((current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def flush() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
            done.clear()
            return out

        for batch in batches:
            for conv_id, part, loss in zip(*(batch.column(c) for c in ("conv_id", "text", "loss")), strict=True):
                if state is None or conv_id.as_py() != current:
                    close()
                    current, state = conv_id.as_py(), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                whole = part.as_py()  # one part at a time is an object, and one turn of it
                for role, text in read_turns(whole):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                raw = whole.encode()
                starts, ends = (pc.struct_field(loss.values, i).to_pylist() for i in range(2))
                for start, end in zip(starts, ends, strict=True):
                    trained = unescape(raw[start:end].decode())
                    state[2] += len(trained)
                    state[3].update(trained.encode())
                state[4] += len(whole)
            if len(done) >= 10_000:
                yield flush()
        close()
        if done:
            yield flush()

    return map_arrow(ordered, run, schema)
