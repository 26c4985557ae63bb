"""Packing documents into training sequences: bounded-space online best fit.

Each partition keeps a fixed number of open windows. A document's full windows
are sequences of their own; its remainder goes to the open window that it fills
best. If it fits in none and no more may be opened, the fullest window is
emitted. The windows still open at the end of the partitions are merged in a
tree of small groups, by fill alone, so no task ever gets more than
`fan_in * open_windows` of them.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.storage import written
from rillflow.llm.tokens import Encoder
from rillflow.llm.wordhash import binary_rows

PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, leftover boolean, ids binary"


class Windows:
    """Open windows of one partition, ordered by free room."""

    def __init__(self, length: int, limit: int, first_id: int):
        self.length, self.limit, self.next_id = length, limit, first_id
        self.open: list[tuple[int, int]] = []  # (room, id)

    def new_id(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def place(self, n: int) -> tuple[int, int]:
        """(window id, offset in it) for n < length tokens."""
        at = bisect.bisect_left(self.open, (n, -1))
        if at < len(self.open):
            room, own = self.open.pop(at)
        else:
            if len(self.open) >= self.limit:
                self.open.pop(0)  # the fullest is emitted
            room, own = self.length, self.new_id()
        if room > n:
            bisect.insort(self.open, (room - n, own))
        return own, self.length - room


def pack_documents(
    docs: DataFrame,
    tokenizer_file: str,
    length: int = 2048,
    open_windows: int = 64,
    fan_in: int = 16,
    end_id: int = 1,
) -> DataFrame:
    """Pieces of all documents, each with its place in a sequence of at most `length` tokens.

    Takes doc_id and text; further columns are ignored, whatever their names.
    A null or empty text is the end id alone; a null doc_id stays null; each row
    is a document, so repeated rows are packed repeatedly. An empty table gives
    no piece. Returns doc_id, start (ids of the document before the piece),
    length, doc_tokens, sequence_id, offset, leftover (it was in a window that
    was merged at the end) and ids (little-endian unsigned 32-bit integers).
    Sequences hold their pieces without gaps from offset 0 and are to be padded
    to `length`. The pieces are written once to the shared folder.
    """

    def pack(batches):
        encoder = Encoder(tokenizer_file, end_id)
        windows = Windows(length, open_windows, TaskContext.get().partitionId() << 32)
        for batch in batches:
            doc_ids = np.asarray(batch.column(0).cast(pa.int64()).fill_null(0))
            missing = np.asarray(batch.column(0).is_null())
            for row, ids, bounds in encoder.encode(batch.column(1)):
                pieces, cuts = [], [0]
                for i, n in enumerate(np.diff(bounds).tolist()):
                    at = 0
                    while n - at >= length:
                        pieces.append((row + i, at, length, n, windows.new_id(), 0))
                        cuts.append(cuts[-1] + length)
                        at += length
                    if n > at:
                        pieces.append((row + i, at, n - at, n, *windows.place(n - at)))
                        cuts.append(cuts[-1] + n - at)
                if not pieces:
                    continue
                table = np.asarray(pieces, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids[table[:, 0]], mask=missing[table[:, 0]]),
                        *(pa.array(table[:, k]) for k in range(1, 6)),
                        pa.array(np.zeros(len(table), bool)),
                        binary_rows(ids.astype("<u4"), np.asarray(cuts)),
                    ],
                    schema=pieces_schema,
                )
        left = [own for _, own in windows.open]
        if left:  # a row without a document for each open window
            n = len(left)
            none = pa.nulls(n, pa.int64())
            zero = pa.array(np.zeros(n, np.int64))
            fill = pa.array([length - room for room, _ in windows.open], pa.int64())
            yield pa.RecordBatch.from_arrays([none, zero, fill, zero, pa.array(left, pa.int64()), zero, pa.array(np.ones(n, bool)), pa.array([b""] * n)], schema=pieces_schema)

    pieces_schema = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("leftover", pa.bool_()), ("ids", pa.binary())]
    )
    first = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pack, PIECE), "pieces")
    pieces, open_ = first.where("NOT leftover"), first.where("leftover")
    moves = merge_windows(open_.select("sequence_id", F.col("length").alias("fill")), length, open_windows, fan_in)
    return pieces.join(moves, "sequence_id", "left").select(
        "doc_id",
        "start",
        "length",
        "doc_tokens",
        F.coalesce("new_id", "sequence_id").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
        F.col("new_id").isNotNull().alias("leftover"),
        "ids",
    )


def merge_windows(open_: DataFrame, length: int, open_windows: int, fan_in: int) -> DataFrame:
    """(sequence_id, new_id, shift) for windows (sequence_id, fill): merged best fit decreasing in groups of `fan_in` partitions, then in groups of those."""

    def merge(table: pa.Table) -> pa.Table:
        group, members, fills, last = (table.column(k).to_pylist() for k in ("group", "sequence_id", "fill", "last"))
        bins: list[tuple[int, int]] = []  # (room, index)
        used, news, shifts, order = [], [], [], sorted(range(len(members)), key=lambda i: (-fills[i], members[i]))
        ids: list[int] = []
        for i in order:
            at = bisect.bisect_left(bins, (fills[i], -1))
            room, own = bins.pop(at) if at < len(bins) else (length, len(ids))
            if own == len(ids):
                ids.append(members[i])
                used.append(0)
            news.append(ids[own])
            shifts.append(length - room)
            used[own] = length - room + fills[i]
            if used[own] < length:
                bisect.insort(bins, (length - used[own], own))
        emptiest = {ids[own] for _, own in bins[-open_windows:]}
        final = [bool(last[0]) or new not in emptiest for new in news]
        total = dict(zip(ids, used))
        return pa.table({"sequence_id": [members[i] for i in order], "new_id": news, "shift": shifts, "total": [total[x] for x in news], "final": final}, schema=merged_schema)

    merged_schema = pa.schema([("sequence_id", pa.int64()), ("new_id", pa.int64()), ("shift", pa.int64()), ("total", pa.int64()), ("final", pa.bool_())])
    span, units = fan_in, open_
    top = open_.agg(F.max(F.shiftright("sequence_id", 32))).first()[0] or 0
    # moved: for each window of the partitions, the window that holds it now.
    moved = open_.select("sequence_id", F.col("sequence_id").alias("now"), F.lit(0).cast("long").alias("moved_by"))
    while True:
        last = span > top
        grouped = units.withColumn("group", F.floor(F.shiftright("sequence_id", 32) / span).cast("long")).withColumn("last", F.lit(last))
        step = written(grouped.groupBy("group").applyInArrow(merge, "sequence_id long, new_id long, shift long, total long, final boolean"), "windows")
        ids = step.select(F.col("sequence_id").alias("now"), "new_id", "shift")
        moved = moved.join(ids, "now", "left").select("sequence_id", F.coalesce("new_id", "now").alias("now"), (F.col("moved_by") + F.coalesce("shift", F.lit(0))).alias("moved_by"))
        if last:
            break
        units = step.where("NOT final").select(F.col("new_id").alias("sequence_id"), F.col("total").alias("fill")).distinct()
        span *= fan_in
    return moved.select("sequence_id", F.col("now").alias("new_id"), F.col("moved_by").alias("shift"))
