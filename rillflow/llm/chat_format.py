"""Conversations as one text each with a loss mask, assembled column by column.

A turn is opener, text and closer of its role; roles other than user, assistant
and system are written out. For a slice of turns numpy computes the lengths of
all segments, their places by cumulative sums, and the place of every byte; the
headers and contents are copied into one buffer, which becomes the Arrow column.

Within roles and texts a backslash goes before each backslash and after the
first character of each control string, so a control string never stands in a
content, and none begins in a content and ends in a closer, as no control string
begins as it ends. Reading back looks for the next closer and drops each
backslash that isn't itself preceded by one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.wordhash import chunks, string_buffers

#: The template, (opener, closer) by kind of turn, and what ends a written role.
USER, ASSISTANT, SYSTEM, OTHER = range(4)
TURN = ((b"[INST] ", b" [/INST]"), (b"<s>", b"</s>"), (b"<<SYS>>", b"<</SYS>>"), (b"[ROLE]", b"[/ROLE]"))
ROLE_END = b"[TEXT]"
CONTROL = (b"[INST]", b"[/INST]", b"<s>", b"</s>", b"<<SYS>>", b"<</SYS>>", b"[ROLE]", b"[/ROLE]", ROLE_END)
NAMES = ("user", "assistant", "system")
ESCAPE = ord("\\")

#: A conversation up to this size is one row of the result; the turns of a longer one go into several.
PART_BYTES = 16 << 20
#: Turns (by number) that stay together when a table is dealt to tasks.
TURNS_TOGETHER = 4096


def insertions(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The places before which the escape goes, ascending; `offsets` cut `data` into contents."""
    places = [np.flatnonzero(data == ESCAPE)]
    firsts = {c: np.flatnonzero(data == c) for c in {control[0] for control in CONTROL}}
    for control in CONTROL:
        at = firsts[control[0]]
        at = at[at + len(control) <= len(data)]
        for k, byte in enumerate(control):
            at = at[data[at + k] == byte]
        inside = np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at + len(control) - 1, "right")
        places.append(at[inside] + 1)
    return np.sort(np.concatenate(places))


class Contents:
    """A column of contents, ready to be copied escaped."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = string_buffers(column)
        self.extra = insertions(self.data, self.offsets)
        #: How many escapes come before each content.
        self.before = np.searchsorted(self.extra, self.offsets)
        self.lengths = np.diff(self.offsets) + np.diff(self.before)

    def copy(self, out: np.ndarray, starts: np.ndarray) -> None:
        """Content i goes to out[starts[i]:]."""
        for a, b in chunks(self.offsets):
            low, high = int(self.offsets[a]), int(self.offsets[b])
            own, extra = self.data[low:high], self.extra[self.before[a] : self.before[b]] - low
            if b == a + 1:
                out[starts[a] : starts[a] + self.lengths[a]] = np.insert(own, extra, ESCAPE) if len(extra) else own
                continue
            shift = np.zeros(high - low + 1, np.int64)
            np.add.at(shift, extra, 1)
            shift = np.cumsum(shift)[:-1] + np.arange(high - low)
            lens = np.diff(self.offsets[a : b + 1])
            move = starts[a:b] - (self.offsets[a:b] - low) - (self.before[a:b] - self.before[a])
            place = shift + np.repeat(move, lens)
            out[place] = own
            if len(extra):
                out[place[extra] - 1] = ESCAPE


def _place(out: np.ndarray, starts: np.ndarray, piece: bytes) -> None:
    out[starts[:, None] + np.arange(len(piece))] = np.frombuffer(piece, np.uint8)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, mask, end of each turn) of consecutive turns; the mask is 1 in what assistants say."""
    kind = np.full(len(roles), OTHER)
    for number, name in enumerate(NAMES):
        kind[pc.equal(roles, name).to_numpy(zero_copy_only=False)] = number
    written = kind == OTHER
    role, text = Contents(pc.if_else(pa.array(written), roles, "")), Contents(texts)
    opener, closer = (np.array([len(turn[i]) for turn in TURN])[kind] for i in (0, 1))
    role_at = opener
    text_at = role_at + role.lengths + written * len(ROLE_END)
    closer_at = text_at + text.lengths
    ends = np.cumsum(closer_at + closer)
    first = ends - closer_at - closer
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for number, (before, after) in enumerate(TURN):
        _place(out, first[kind == number], before)
        _place(out, (first + closer_at)[kind == number], after)
    _place(out, (first + role_at + role.lengths)[written], ROLE_END)
    role.copy(out, first + role_at)
    text.copy(out, first + text_at)
    said = kind == ASSISTANT
    change = np.zeros(len(out) + 1, np.int8)
    np.add.at(change, (first + text_at)[said], 1)
    np.add.at(change, (first + closer_at)[said], -1)
    return out, np.cumsum(change[:-1], dtype=np.int8).view(np.uint8), ends


OUTPUT = "conv_id long, part long, n_turns long, text string, loss_mask binary"
ARROW = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("n_turns", pa.int64()), ("text", pa.string()), ("loss_mask", pa.binary())])


def _starts(batch) -> np.ndarray:
    """The first row of each run of one conversation, and the number of rows."""
    ids, known = pc.fill_null(batch["conv_id"], 0).to_numpy(zero_copy_only=False), pc.is_valid(batch["conv_id"]).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero((ids[1:] != ids[:-1]) | (known[1:] != known[:-1])) + 1, [batch.num_rows]])


def _rows(batch: pa.RecordBatch, starts: np.ndarray, part: int) -> pa.RecordBatch:
    """One row for each run of one conversation."""
    out, mask, ends = assemble(batch["role"], batch["text"])
    offsets = pa.py_buffer(np.concatenate([[0], ends])[starts].astype(np.int32))
    n = len(starts) - 1
    text = pa.Array.from_buffers(pa.string(), n, [None, offsets, pa.py_buffer(out)])
    masks = pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(mask)])
    return pa.RecordBatch.from_arrays([batch["conv_id"].take(pa.array(starts[:-1])), pa.array(part + np.arange(n)), pa.array(np.diff(starts)), text, masks], schema=ARROW)


def _format(batches):
    from pyspark import TaskContext

    part, held = TaskContext.get().partitionId() << 33, []

    def emit(batch):
        nonlocal part
        starts = _starts(batch)
        size = string_buffers(batch["text"])[1] + string_buffers(batch["role"])[1]
        for a, b in chunks(size[starts]):
            own = batch.slice(int(starts[a]), int(starts[b] - starts[a]))
            yield _rows(own, starts[a : b + 1] - starts[a], part)
            part += b - a

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        last = int(_starts(batch)[-2])
        if not last and held[0]["conv_id"][-1] == batch["conv_id"][0] and sum(b.nbytes for b in held) < PART_BYTES:
            continue  # the same conversation goes on
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        last = int(_starts(whole)[-2])
        if whole.nbytes - whole.slice(0, last).nbytes >= PART_BYTES:
            last = whole.num_rows
        held = [whole.slice(last)] if last < whole.num_rows else []
        if last:
            yield from emit(whole.slice(0, last))
    if held:
        yield from emit(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def format_chats(rows: DataFrame) -> DataFrame:
    """`rows` (conv_id, turn, role, text) as formatted texts: conv_id, part, n_turns, text, and loss_mask with a byte for each byte of the text.

    Turns go by number, nulls first, those of one number by role and then by
    hashes of the text; repeated rows are turns of their own. A null text or role
    is empty, a null conv_id a conversation of its own; other columns are
    ignored; an empty table gives none. A conversation above 16 MB, or with more
    than 4096 turns, may come in several parts, ascending by `part`; texts of all
    parts make the whole. So no task holds more than a part and a batch.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"))
    rows = rows.withColumns({"together": F.floor(F.col("turn") / TURNS_TOGETHER), "t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit("t"), "text")})
    ordered = rows.repartitionByRange("conv_id", "together").sortWithinPartitions("conv_id", "turn", "role", "t1", "t2")
    return ordered.select("conv_id", "role", "text").mapInArrow(_format, OUTPUT)


def unescaped(content: bytes) -> bytes:
    if b"\\" not in content:
        return content
    pieces = content.split(b"\\\\")  # what stands between escaped backslashes holds only those after a first character
    return b"\\".join(piece.replace(b"\\", b"") for piece in pieces)


def read_turns(text: bytes):
    """(role, text) of each turn of a formatted text."""
    at = 0
    while at < len(text):
        kind = next(k for k, (before, _) in enumerate(TURN) if text.startswith(before, at))
        at += len(TURN[kind][0])
        role = NAMES[kind].encode() if kind != OTHER else None
        if role is None:
            end = text.index(ROLE_END, at)
            role, at = unescaped(text[at:end]), end + len(ROLE_END)
        end = text.index(TURN[kind][1], at)
        yield role, unescaped(text[at:end])
        at = end + len(TURN[kind][1])


def masked(text: bytes, mask: bytes) -> bytes:
    """What stands under the loss mask, as it was said."""
    flags = np.frombuffer(mask, np.uint8)
    return unescaped(np.frombuffer(text, np.uint8)[flags == 1].tobytes())


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
DIGEST_ARROW = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in DIGEST.split(", ")])


def _characters(data: bytes) -> int:
    return len(data) - int((np.frombuffer(data, np.uint8) & 0xC0 == 0x80).sum())


def _digest(batches):
    """One row for each conversation of a stream of parts in order."""
    now, out = None, []

    def closed():
        conv, n, turns, chars, loss, whole = now
        out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), whole))

    for batch in batches:
        ids = batch["conv_id"].to_pylist()
        for conv, text, mask in zip(ids, batch["text"].cast(pa.large_binary()), batch["loss_mask"]):
            if now is None or now[0] != conv:
                if now is not None:
                    closed()
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            text, said = text.as_py(), b""
            for role, content in read_turns(text):
                now[1] += 1
                now[2].update(role + b"\n" + content + b"\n")
            said = masked(text, mask.as_py())
            now[3] += _characters(said)
            now[4].update(said)
            now[5] += _characters(text)
        if len(out) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), DIGEST_ARROW.types)], schema=DIGEST_ARROW)
            out = []
    if now is not None:
        closed()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), DIGEST_ARROW.types)], schema=DIGEST_ARROW)


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the parts of `formatted`: turns and their hash, what is under the loss mask, and the length.

    A hash runs over a conversation in order, part by part: a task holds one part.
    """
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.select("conv_id", "text", "loss_mask").mapInArrow(_digest, DIGEST)
