"""Chat formatting by columnar byte assembly.

Turns arrive sorted; for each Arrow batch the lengths of all segments give cumulative offsets, and headers, escaped
contents and ends are copied into one preallocated buffer. The buffer, cut at the conversations' ends, is an Arrow
string column: no string is built per turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

# Fixed marks of the template.
START, END = "<|im_start|>", "<|im_end|>"
SCHEMA = "conv_id long, part int, last boolean, n_turns long, formatted string, loss_spans array<struct<start:long,stop:long>>"


def escape(texts: pa.Array) -> pa.Array:
    """One more backslash in every ``<|``, ``<\\|``, ``<\\\\|``...: after it no mark can occur in a text."""
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\\\1|")


def unescape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<\\(\\*)\|", r"<\1|")


def escape_role(roles: pa.Array) -> pa.Array:
    """A role ends at the first line end, so its own line ends are written as ``\\n`` after doubling backslashes."""
    return escape(pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n"))


def unescape_role(role: str) -> str:
    role, out, at = unescape(pa.array([role], pa.large_string()))[0].as_py(), [], 0
    while at < len(role):
        if role[at] == "\\":
            at += 1
            out.append("\n" if role[at] == "n" else role[at])
        else:
            out.append(role[at])
        at += 1
    return "".join(out)


def assemble(pieces: list[pa.Array | bytes], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows' pieces, row by row, in one buffer, and where each piece begins (rows x pieces, flat, and the end)."""
    lens = np.empty((rows, len(pieces)), np.int64)
    for j, p in enumerate(pieces):
        lens[:, j] = len(p) if isinstance(p, bytes) else pc.binary_length(p).to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(lens.ravel())))
    out = np.empty(int(starts[-1]), np.uint8)
    for j, p in enumerate(pieces):
        at = starts[:-1].reshape(rows, -1)[:, j]
        if isinstance(p, bytes):
            out[at[:, None] + np.arange(len(p))] = np.frombuffer(p, np.uint8)
        else:
            offsets = np.frombuffer(p.buffers()[1], np.int64)[p.offset : p.offset + rows + 1]
            data = np.frombuffer(p.buffers()[2], np.uint8) if p.buffers()[2] else out[:0]
            out[np.repeat(at - offsets[:-1], lens[:, j]) + np.arange(offsets[0], offsets[-1])] = data[offsets[0] : offsets[-1]]
    return out, starts


def _blocks(batches: Iterator[pa.RecordBatch], bytes_most: int) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """The batches cut to blocks of at most bytes_most bytes of text (one turn at least); True if the next begins within the same conversation."""
    held = None
    for batch in batches:
        at, sizes = 0, np.cumsum(pc.binary_length(batch.column("text").cast(pa.large_string())).to_numpy(zero_copy_only=False))
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + bytes_most, "right")))
            block, at = batch.slice(at, stop - at), stop
            if held is not None:
                yield held, held.column("conv")[-1].as_py() == block.column("conv")[0].as_py()
            held = block
    if held is not None:
        yield held, False


def format_blocks(batches: Iterator[pa.RecordBatch], bytes_most: int, trained: str) -> Iterator[pa.RecordBatch]:
    carried, part = None, 0
    for block, open_end in _blocks(batches, bytes_most):
        n = block.num_rows
        roles, texts = (block.column(c).cast(pa.large_string()) for c in ("role", "text"))
        out, starts = assemble([START.encode(), escape_role(roles), b"\n", escape(texts), (END + "\n").encode()], n)
        conv = block.column("conv").to_numpy(zero_copy_only=False)
        null = block.column("none").to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.concatenate(([True], (conv[1:] != conv[:-1]) | (null[1:] != null[:-1]))))
        ends = np.append(cut[1:], n)
        points = np.concatenate(([0], np.cumsum((out & 0xC0) != 0x80)))  # code points before each byte
        begin, stop = points[starts[3:-1:5]], points[starts[4:-1:5]]
        loss = pc.equal(roles, trained).to_numpy(zero_copy_only=False).astype(bool)
        rows = []
        for a, b in zip(cut, ends, strict=True):
            base, key = points[starts[5 * a]], None if null[a] else int(conv[a])
            part = part + 1 if a == 0 and carried == (key,) else 0
            last = not (open_end and b == n)
            spans = [{"start": int(begin[i] - base), "stop": int(stop[i] - base)} for i in np.flatnonzero(loss[a:b]) + a]
            rows.append((key, part, last, int(b - a), spans))
            carried = (key,)
        offsets = starts[np.append(5 * cut, 5 * n)].astype(np.int32)
        text = pa.StringArray.from_buffers(len(rows), pa.py_buffer(offsets), pa.py_buffer(out))
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows]), pa.array([r[3] for r in rows], pa.int64()), text, pa.array([r[4] for r in rows], span)],
            ["conv_id", "part", "last", "n_turns", "formatted", "loss_spans"],
        )


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", *, trained: str = "assistant", bytes_most: int = 32 << 20) -> DataFrame:
    """Conversations as template text: conv_id, part, last, n_turns, formatted, loss_spans (code points of formatted, trained role's contents).

    Each turn becomes ``<|im_start|>role\\ncontent<|im_end|>\\n``. Turns go by turn number (nulls first), ties by role,
    then text. Null roles and texts count as empty; a null conversation id is a conversation of its own; ids are integers.
    A conversation has one row (part 0) unless its texts pass bytes_most; then its parts follow each other, cut between
    turns, so a conversation of any length runs in bounded memory. Other columns are ignored; no rows give none.
    """
    rows = turns.select(
        F.coalesce(F.col(conv_col).cast("long"), F.lit(0)).alias("conv"), F.col(conv_col).isNull().alias("none"), F.col(turn_col).alias("turn"), text_of(role_col).alias("role"), text_of(text_col).alias("text")
    )
    rows = rows.repartition("conv", "none").sortWithinPartitions("conv", "none", "turn", "role", "text").select("conv", "none", "role", "text")
    return rows.mapInArrow(lambda batches: format_blocks(batches, bytes_most, trained), SCHEMA)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns that were formatted."""
    if not formatted:
        return []
    bodies = [x.split("\n", 1) for x in formatted.removeprefix(START).removesuffix(END + "\n").split(END + "\n" + START)]
    texts = unescape(pa.array([b for _, b in bodies], pa.large_string())).to_pylist()
    return [(unescape_role(r), t) for (r, _), t in zip(bodies, texts, strict=True)]


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads formatted rows (parts in order) back and sums each conversation up."""
    turns = loss = None
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["part"] == 0:
                turns, loss, n, chars, length = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            text = row["formatted"]
            for role, body in parse(text):
                turns.update(f"{role}\n{body}\n".encode())
                n += 1
            for body in unescape(pa.array([text[s["start"] : s["stop"]] for s in row["loss_spans"]], pa.large_string())).to_pylist():
                loss.update(body.encode())
                chars += len(body)
            length += len(text)
            if row["last"]:
                out.append((row["conv_id"], n, turns.hexdigest(), chars, loss.hexdigest(), length))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(6)], names)


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation of ``format_chats``: what its text says when it is parsed again. Narrow: the parts of a conversation follow each other in one partition."""
    return formatted.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
