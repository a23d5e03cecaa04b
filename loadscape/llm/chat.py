"""Chat formatting by columnar byte assembly, and reading it back.

A turn becomes ``### role: text</turn>`` and a line feed. Within role and text a backslash is put before every backslash,
after the first of three number signs and after the ``<`` of ``</turn>`` (in a role also before a colon), so no control
string can occur in them, and taking away each backslash that is not itself so marked gives the old text. Segment
lengths, cumulative offsets and scatter indices are computed in numpy for all turns of a batch, and headers and contents
copied into one preallocated buffer, which is the data of the resulting Arrow column.
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

from loadscape.llm.arrow import map_batches, named

HEAD, AFTER_ROLE, END = b"### ", b": ", b"</turn>\n"
LOSS_ROLE = b"assistant"
#: Role and text bytes, and turns, of one conversation that are formatted at once; a longer one is given in parts.
PART_BYTES, PART_TURNS = 16 << 20, 100_000
_TURN = re.compile(rb"### ((?:[^\\:]|\\.)*): (.*)", re.S)
_MARK = re.compile(rb"\\(.)", re.S)


def _marks(data: np.ndarray, ends: np.ndarray, colon: bool) -> np.ndarray:
    """Whether a backslash goes before each byte; patterns do not reach over the end of a segment."""
    out = data == ord("\\")
    if colon:
        out |= data == ord(":")
    limit = np.repeat(ends[1:], np.diff(ends))
    for word in (b"###", b"</turn>"):
        n = len(word)
        if len(data) >= n:
            hit = np.logical_and.reduce([data[k : len(data) - n + 1 + k] == c for k, c in enumerate(word)])
            at = np.flatnonzero(hit)
            out[at[at + n <= limit[at]] + 1] = True
    return out


def _segments(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large binary column without nulls."""
    ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.empty(0, np.uint8)
    return data, ends - ends[0]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns; (buffer, where each turn starts and the end, start and length of each content)."""
    n, copies, lengths = len(roles), [], []
    for column, colon in ((roles, True), (texts, False)):
        data, ends = _segments(column)
        marks = _marks(data, ends, colon)
        before = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
        moved = ends + before[ends]
        copies.append((data, ends, marks, before, moved))
        lengths.append(np.diff(moved))
    size = len(HEAD) + lengths[0] + len(AFTER_ROLE) + lengths[1] + len(END)
    starts = np.concatenate(([0], np.cumsum(size)))
    role_at = starts[:-1] + len(HEAD)
    text_at = role_at + lengths[0] + len(AFTER_ROLE)
    out = np.empty(starts[-1], np.uint8)
    for at, word in ((starts[:-1], HEAD), (role_at + lengths[0], AFTER_ROLE), (text_at + lengths[1], END)):
        out[(at[:, None] + np.arange(len(word))).ravel()] = np.tile(np.frombuffer(word, np.uint8), n)
    for at, (data, ends, marks, before, moved) in zip((role_at, text_at), copies):
        to = np.arange(len(data)) + before[1:] + np.repeat(at - moved[:-1], np.diff(ends))
        out[to] = data
        out[to[marks] - 1] = ord("\\")
    return out, starts, text_at, lengths[1]


def _starts(keys: pa.Array) -> np.ndarray:
    """Where each run of equal keys starts, and the end; null equals null."""
    ends = pc.run_end_encode(keys, run_end_type=pa.int64()).run_ends.to_numpy()
    return np.concatenate(([0], ends))


def _format(part_bytes: int, part_turns: int):
    def flush(batches: list[pa.RecordBatch], part: int) -> pa.RecordBatch:
        """Conversations of whole turns, each as one row; ``part`` numbers the first one's."""
        table = pa.Table.from_batches(batches)
        keys = table.column("key").combine_chunks()
        roles, texts = (table.column(c).combine_chunks().cast(pa.large_binary()).fill_null(b"") for c in ("role", "text"))
        out, starts, at, n = assemble(roles, texts)
        bounds = _starts(keys)
        firsts, turns = bounds[:-1], np.diff(bounds)
        own = np.repeat(np.arange(len(firsts)), turns)
        text_ends = starts[bounds]
        loss = pc.equal(roles, pa.scalar(LOSS_ROLE, pa.large_binary())).to_numpy(zero_copy_only=False)
        spans = np.append(0, np.cumsum(np.bincount(own[loss], minlength=len(firsts))))
        formatted = pa.Array.from_buffers(pa.large_utf8(), len(firsts), [None, pa.py_buffer(text_ends.astype(np.int64)), pa.py_buffer(out)]).cast(pa.string())
        relative = at[loss] - text_ends[:-1][own[loss]]
        lists = [pa.ListArray.from_arrays(pa.array(spans.astype(np.int32)), pa.array(x)) for x in (relative, n[loss])]
        parts = np.zeros(len(firsts), np.int64)
        parts[0] = part
        return pa.RecordBatch.from_arrays([keys.take(pa.array(firsts)), pa.array(parts), pa.array(turns), formatted, *lists], names=["key", "part", "n_turns", "formatted", "loss_start", "loss_length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # turns of the last conversation, not given yet
        key, part, turns, size = None, 0, 0, 0  # that conversation, its parts given, and what is held of it
        for batch in (b for b in batches if b.num_rows):
            last = int(_starts(batch.column("key"))[-2])
            goes_on = key is not None and batch.column("key")[0].equals(key)
            if not goes_on or last:
                done = [*held, *([batch.slice(0, last)] if goes_on and last else [])]
                if done:
                    yield flush(done, part)
                if last and not goes_on:
                    yield flush([batch.slice(0, last)], 0)
                held, part, turns, size = [], 0, 0, 0
            rest = batch.slice(last)
            held.append(rest)
            key, turns, size = rest.column("key")[0], turns + rest.num_rows, size + rest.column("text").nbytes + rest.column("role").nbytes
            if turns >= part_turns or size > part_bytes:
                yield flush(held, part)
                held, part, turns, size = [], part + 1, 0, 0
        if held:
            yield flush(held, part)

    return run


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_bytes: int = PART_BYTES, part_turns: int = PART_TURNS) -> DataFrame:
    """(id_col, part, n_turns, formatted, loss_start, loss_length): each conversation's turns, in order, as one text.

    loss_start and loss_length are the byte spans of the assistant contents within ``formatted``: the loss mask. Null
    roles and texts are empty; turns are ordered by turn (null first), then role and text, so repeated turns all stay and
    ties have one order. Null ids are one conversation. A conversation of over ``part_bytes`` of roles and texts, or of
    ``part_turns`` turns or more, comes in several rows, numbered by ``part`` and cut between Arrow batches, so no task
    holds it whole; rows of a conversation follow each other in one partition. Other columns are not read; an empty table
    gives no rows.
    """
    rows = turns.select(named(id_col).alias("key"), named(turn_col).alias("turn"), named(role_col).cast("string").alias("role"), named(text_col).cast("string").alias("text"))
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "key").sortWithinPartitions("key", "turn", "role", "text").select("key", "role", "text")
    kind = rows.schema["key"].dataType.simpleString()
    out = map_batches(rows, _format(part_bytes, part_turns), f"key {kind}, part bigint, n_turns bigint, formatted string, loss_start array<bigint>, loss_length array<bigint>")
    return out.withColumnRenamed("key", id_col)


def unescape(content: bytes) -> bytes:
    return _MARK.sub(rb"\1", content) if b"\\" in content else content


def turns_of(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of each turn of a formatted conversation."""
    return [tuple(map(unescape, _TURN.fullmatch(x).groups())) for x in formatted.split(END)[:-1]]


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state, done, last = None, None, [], -1

    def close():
        if state:
            done.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    for batch in batches:
        done.clear()
        for k, part, _, formatted, starts, lengths in zip(*(c.to_pylist() for c in batch.columns)):
            if part == 0:
                close()
                key, state = k, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            elif state is None or k != key or part != last + 1:
                raise ValueError(f"part {part} of conversation {k} does not follow part {part - 1}; read_back takes unordered parts with ordered=False")
            last = part
            data = formatted.encode()
            for role, text in turns_of(data):
                state[0] += 1
                state[1].update(role + b"\n" + text + b"\n")
            for a, n in zip(starts, lengths):
                text = unescape(data[a : a + n])
                state[2] += len(text.decode())
                state[3].update(text)
            state[4] += len(formatted)
        yield _digests(done, batch.schema[0].type)
    done.clear()
    close()
    if done:
        yield _digests(done, batch.schema[0].type)


def _digests(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = [*zip(*rows)] or [[]] * 6
    types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(formatted: DataFrame, id_col: str = "conv_id", ordered: bool = True) -> DataFrame:
    """(id_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), parsed from formatted conversations.

    The input is what ``format_conversations`` gives, in its partitions and order, so a conversation's parts follow each
    other and are digested one after another; where they do not, as in a table written and read again, it is an error
    unless ``ordered`` is False: then they are shuffled and sorted. Texts under the loss mask are digested unescaped, in
    order. Null ids are one conversation; an empty table gives no rows.
    """
    rows = formatted.select(named(id_col).alias("key"), "part", "n_turns", "formatted", "loss_start", "loss_length")
    if not ordered:
        rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key", "part")
    kind = rows.schema["key"].dataType.simpleString()
    return map_batches(rows, _read_back, f"key {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint").withColumnRenamed("key", id_col)
