"""Chat formatting: turns become one marked text per conversation, assembled as columns of bytes.

Template: a user's turn is ``[INST] text [/INST]``, an assistant's `` text</s>``, any other one
``[TURN] role``, a line end, ``text [/TURN]``. Control strings inside texts and roles get a
backslash after their first sign (one more where there are some already), so that only the template's
own marks are whole; reading takes it away again.

1. Rows are dealt by ranges of (conversation, turn, ...), which cuts a conversation of any length.
2. In a task, bounded slices of rows are put together at once: lengths of all segments, their
   cumulative offsets, and an index of source bytes that fills one preallocated buffer.
3. A slice's rows of one conversation are one part. Parts in order are the conversation's text; one
   that lies inside a task and a slice is a single whole part.
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

# The strings that a text must not hold whole.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[TURN]", "[/TURN]")
# Bytes of text that are put together at once; a longer text is a slice of its own.
SLICE = 1 << 20
# Segments of a turn: mark, role, mark, text, mark. The marks by kind of turn.
USER, ASSISTANT, OTHER = range(3)
_OPEN = (b"[INST] ", b" ", b"[TURN] ")
_MIDDLE = (b"", b"", b"\n")
_CLOSE = (b" [/INST]", b"</s>", b" [/TURN]")

_ESCAPE = r"(<)(\\*)(/?s>)|(\[)(\\*)(/?(?:INST|TURN)\])"
_UNESCAPE = re.compile(r"(<)\\(\\*)(/?s>)|(\[)\\(\\*)(/?(?:INST|TURN)\])")
_TURN = re.compile(r"\[INST\] (.*?) \[/INST\]|\[TURN\] ([^\n]*)\n(.*?) \[/TURN\]| (.*?)</s>", re.S)
_ROLE_SIGN = re.compile(r"\\(.)")


def escaped(texts: pa.Array) -> pa.Array:
    """Texts without whole control strings."""
    return pc.replace_substring_regex(texts, _ESCAPE, r"\1\4\\\2\5\3\6")


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"\1\4\2\5\3\6", text) if "\\" in text else text


def _escaped_roles(roles: pa.Array) -> pa.Array:
    """As texts, and without line ends."""
    return pc.replace_substring(pc.replace_substring(escaped(roles), "\\", "\\\\"), "\n", "\\n")


def _unescaped_role(role: str) -> str:
    return unescaped(_ROLE_SIGN.sub(lambda m: "\n" if m[1] == "n" else m[1], role))


def turns_of(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted text."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        if m.lastindex == 1:
            out.append(("user", unescaped(m[1])))
        elif m.lastindex == 4:
            out.append(("assistant", unescaped(m[4])))
        else:
            out.append((_unescaped_role(m[2]), unescaped(m[3])))
        at = m.end()
    return out


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and data of a string column without nulls."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


def assembled(kinds: np.ndarray, roles: pa.Array, texts: pa.Array, first: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Formatted texts of groups of turns, and where each turn's own text starts in its group, in code points.

    ``kinds``, ``roles`` and ``texts`` (both escaped) are of one turn each, ``first`` has the first
    turn of every group.
    """
    role_at, role_data = _bytes_of(roles)
    text_at, text_data = _bytes_of(texts)
    marks = [np.frombuffer(b"".join(m), np.uint8) for m in (_OPEN, _MIDDLE, _CLOSE)]
    pool = np.concatenate([*marks, role_data, text_data])
    bases = np.cumsum([0, *map(len, marks), len(role_data)])
    # Segment lengths and sources, one row per turn and one column per segment.
    sizes = np.empty((len(kinds), 5), np.int64)
    sources = np.empty((len(kinds), 5), np.int64)
    for column, base, of_kind in ((0, bases[0], _OPEN), (2, bases[1], _MIDDLE), (4, bases[2], _CLOSE)):
        lengths = np.array([len(m) for m in of_kind])
        sizes[:, column] = lengths[kinds]
        sources[:, column] = base + (np.cumsum(lengths) - lengths)[kinds]
    for column, base, at in ((1, bases[3], role_at), (3, bases[4], text_at)):
        sizes[:, column] = np.diff(at)
        sources[:, column] = base + at[:-1]
    ends = np.cumsum(sizes)
    starts = ends - sizes.ravel()
    total = int(ends[-1])
    buffer = pa.allocate_buffer(total)
    out = np.frombuffer(buffer, np.uint8)
    if total <= 4 * SLICE:
        index = np.repeat(sources.ravel() - starts, sizes.ravel())
        index += np.arange(total)
        np.take(pool, index, out=out)
    else:  # one very long text: an index of its bytes would be eight times as long
        for source, start, size in zip(sources.ravel().tolist(), starts.tolist(), sizes.ravel().tolist()):
            out[start : start + size] = pool[source : source + size]
    offsets = np.append(starts[first * 5], total).astype(np.int32)
    groups = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), buffer)
    # The same offsets in code points: marks are ASCII.
    chars = sizes.copy()
    chars[:, 1] = pc.utf8_length(roles).to_numpy(zero_copy_only=False)
    chars[:, 3] = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    before = (np.cumsum(chars) - chars.ravel()).reshape(-1, 5)
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(kinds))))
    return groups, np.stack([before[:, 3], before[:, 3] + chars[:, 3]], axis=1) - before[first, 0][group][:, None]


_LOSS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_PART_NAMES = ["conv_id", "part", "whole", "n_turns", "text", "loss"]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """Conversation, role and text of successive rows, ``SLICE`` bytes of text or one row at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, role, text = (batch.column(i) for i in range(3))
        sizes = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(sizes // SLICE)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:]):
            yield conv.slice(a, b - a), role.slice(a, b - a), text.slice(a, b - a)


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 40
    # A slice waits until the next one says whether its last conversation goes on.
    waiting: dict | None = None
    last = None
    begun = False

    def done(parts: dict, ends: bool) -> pa.RecordBatch:
        whole = parts["whole"]
        whole[-1] &= ends
        columns = [parts["conv_id"], pa.array(parts["part"]), pa.array(whole), pa.array(parts["n_turns"]), parts["text"], parts["loss"]]
        return pa.RecordBatch.from_arrays(columns, _PART_NAMES)

    for conv, role, text in _slices(batches):
        ids = conv.to_pylist()
        new = np.array([not begun or ids[0] != last, *(a != b for a, b in zip(ids, ids[1:]))])
        if waiting is not None:
            yield done(waiting, bool(new[0]))
        first = np.flatnonzero(np.concatenate([[True], new[1:]]))
        roles = pc.fill_null(role.cast(pa.large_string()), "")
        kinds = np.full(len(ids), OTHER)
        kinds[pc.equal(roles, "user").to_numpy(zero_copy_only=False)] = USER
        kinds[pc.equal(roles, "assistant").to_numpy(zero_copy_only=False)] = ASSISTANT
        named = pc.if_else(pa.array(kinds == OTHER), _escaped_roles(roles), pa.scalar("", pa.large_string()))
        texts = escaped(pc.fill_null(text.cast(pa.large_string()), ""))
        groups, spans = assembled(kinds, named, texts, first)
        sizes = np.diff(np.append(first, len(ids)))
        learned = np.flatnonzero(kinds == ASSISTANT)
        loss_at = np.searchsorted(learned, np.append(first, len(ids))).astype(np.int32)
        loss = pa.StructArray.from_arrays([pa.array(spans[learned, i].astype(np.int32)) for i in range(2)], ["start", "end"])
        # The task's first conversation may have begun in the task before.
        whole = np.ones(len(first), bool)
        whole[0] = begun and bool(new[0])
        waiting = {
            "conv_id": pa.array([ids[i] for i in first.tolist()], pa.int64()), "part": number + np.arange(len(first)),
            "whole": whole, "n_turns": sizes, "text": groups, "loss": pa.ListArray.from_arrays(pa.array(loss_at), loss),
        }
        number += len(first)
        last, begun = ids[-1], True
    if waiting is not None:
        yield done(waiting, False)


def formatted(rows: DataFrame) -> DataFrame:
    """Formatted conversations of rows (``conv_id``, ``turn``, ``role``, ``text``).

    One row per part: ``conv_id``, ``part`` (their order), ``whole`` (the part is all of its
    conversation; false also where a task cannot tell), ``n_turns``, ``text``, and ``loss``, the
    (``start``, ``end``) of every assistant's text in it, in code points. Turns come in order; a null
    turn is first, and of rows with one turn the order is that of role, hash of the text, and place in
    the table, so repeated rows all stay. A null text or role is empty, rows without a conversation
    are one conversation. Other columns are ignored; an empty table stays empty.
    """
    own = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
        F.col("turn").cast("long").alias("turn"),
        F.xxhash64(F.col("text").cast("string")).alias("mixed"),
        F.monotonically_increasing_id().alias("place"),
    )
    order = ("conv_id", "turn", "role", "mixed", "place")
    dealt = own.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text")
    return dealt.mapInArrow(
        _formatted, "conv_id long, part long, whole boolean, n_turns long, text string, loss array<struct<start:int,end:int>>"
    )


class _Digests:
    """What is read back of one conversation, part by part."""

    def __init__(self) -> None:
        self.n_turns = self.loss_chars = self.chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, loss: list[dict]) -> None:
        for role, said in turns_of(text):
            self.n_turns += 1
            self.turns.update(f"{role}\n{said}\n".encode())
        for span in loss:
            learned = unescaped(text[span["start"] : span["end"]])
            self.loss_chars += len(learned)
            self.loss.update(learned.encode())
        self.chars += len(text)

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_DIGEST_FIELDS = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
_READ = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), *_DIGEST_FIELDS, ("text", pa.string()), ("loss", _LOSS)])
_DDL = "conv_id long, {}n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of whole conversations; parts of others pass."""
    for batch in batches:
        out = []
        for conv, part, whole, _, text, loss in zip(*(c.to_pylist() for c in batch.columns)):
            if whole:
                one = _Digests()
                one.add(text, loss)
                out.append((conv, part, *one.row(), None, None))
            else:
                out.append((conv, part, *[None] * 5, text, loss))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * 9, _READ)], schema=_READ)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose parts come in order; finished ones pass."""
    schema = pa.schema([("conv_id", pa.int64()), *_DIGEST_FIELDS])
    open_conv, digests = None, None
    for batch in batches:
        out = []
        for conv, _, *fields, text, loss in zip(*(batch.column(i).to_pylist() for i in range(len(_READ)))):
            if digests is not None and (text is None or conv != open_conv):
                out.append((open_conv, *digests.row()))
                digests = None
            if text is None:
                out.append((conv, *fields))
                continue
            if digests is None:
                open_conv, digests = conv, _Digests()
            digests.add(text, loss)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    if digests is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((open_conv, *digests.row()), schema)], schema=schema)


def read_back(parts: DataFrame) -> DataFrame:
    """Digests per conversation, read from the formatted parts alone: ``n_turns``, ``turns_sha256``,
    ``loss_chars``, ``loss_sha256`` and ``formatted_chars``.

    Whole conversations are read where they are. Only parts of others move: a digest takes its bytes in
    order, so the parts of one conversation stream through one task, one part in memory at a time.
    """
    read = parts.select(*_PART_NAMES).mapInArrow(_read, _DDL.format("part long, ") + ", text string, loss array<struct<start:int,end:int>>")
    return read.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_joined, _DDL.format(""))
