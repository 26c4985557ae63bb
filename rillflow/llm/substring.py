"""Substring dedup by difference-cover anchors.

A window is `width` consecutive words. With a difference cover D modulo a
period p, any two equal windows, wherever they start in their documents, hold
at one common offset below p a position that is in D modulo p in both. So
hashes of short runs of words ("anchors", width - p + 1 words) at the cover
positions alone find every repeated window: a window that recurs contains an
anchor that recurs. Only windows around recurring anchors are then hashed in
full, and each is held against the smallest doc_id in which it starts.

Hashes travel packed: a row carries all hashes of one Arrow batch that fall
into one bucket. A bucket has a bounded number of hashes by the choice of their
number. What a batch can decide alone doesn't take part: of a hash that several
of its documents share, only the places of the smallest document, and for
anchors of the largest, go to the bucket, the others go by as found. So a window
that stands in every document brings one or two documents a batch into its
bucket, however many there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.tokens import expand
from rillflow.llm.wordhash import U64, WordHasher, Words, binary_rows, chunks, from_binary, string_buffers

#: A perfect difference set for each period.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9)}

PACKED = pa.schema([("bucket", pa.int64()), ("docs", pa.binary()), ("texts", pa.binary()), ("counts", pa.binary()), ("places", pa.binary()), ("hashes", pa.binary())])
PACKED_SQL = "bucket long, docs binary, texts binary, counts binary, places binary, hashes binary"
FOUND = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("places", pa.binary())])
FOUND_SQL = "doc_id long, text_hash long, places binary"


class Packer:
    """Collects (document, place, bucket, hash) of one Arrow batch and packs them by bucket.

    `ends`: whether the largest document of a hash goes to the bucket too, beside
    the smallest. The places of the others are found already: they go, without
    hashes, to buckets picked by the document.
    """

    def __init__(self, kind, buckets: int, ends: bool):
        self.kind, self.buckets, self.ends, self.parts = kind, buckets, ends, []

    def add(self, doc: np.ndarray, place: np.ndarray, bucket: np.ndarray, value: np.ndarray) -> None:
        self.parts.append((doc, place.astype(np.uint32), bucket.astype(np.int64), value.astype(self.kind)))

    def batches(self, doc_ids: np.ndarray, texts: np.ndarray):
        """Up to two record batches: what the buckets are to decide, and what is found."""
        parts = [p for p in self.parts if len(p[0])]
        if not parts:
            return
        doc, place, bucket, value = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((value, bucket))
        ids = doc_ids[doc[order]]
        first = np.flatnonzero(np.append(True, (np.diff(bucket[order]) != 0) | (value[order][1:] != value[order][:-1])))
        size = np.diff(np.append(first, len(order)))
        open_ = ids == np.repeat(np.minimum.reduceat(ids, first), size)
        if self.ends:
            open_ |= ids == np.repeat(np.maximum.reduceat(ids, first), size)
        undecided = np.empty(len(order), bool)
        undecided[order] = open_
        for some in (np.flatnonzero(undecided), np.flatnonzero(~undecided)):
            if len(some):
                if not undecided[some[0]]:
                    bucket, value = (doc_ids[doc] & 0x7FFFFFFF) % self.buckets, np.zeros(0, self.kind)
                yield self._packed(doc[some], place[some], bucket[some], value[some] if len(value) else None, doc_ids, texts)

    def _packed(self, doc, place, bucket, value, doc_ids, texts) -> pa.RecordBatch:
        order = np.argsort(bucket, kind="stable")  # documents and places stay ascending in a bucket
        doc, place, bucket = doc[order], place[order], bucket[order]
        row = np.flatnonzero(np.diff(bucket, prepend=-1))
        run = np.flatnonzero((np.diff(bucket, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
        counts = np.diff(np.append(run, len(doc))).astype(np.uint32)
        runs = np.append(np.searchsorted(run, row), len(run))
        rows = np.append(row, len(doc))
        owner = doc[run]
        hashes = binary_rows(value[order], rows) if value is not None else pa.nulls(len(row), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[row]), binary_rows(doc_ids[owner], runs), binary_rows(texts[owner], runs), binary_rows(counts, runs), binary_rows(place, rows), hashes],
            schema=PACKED,
        )


def unpack(table: pa.Table, kind):
    """(doc_id, text_hash, count, place, hash) arrays of a bucket's rows that have hashes, and a table of those found already."""
    known = table.filter(pc.is_null(table.column("hashes")))
    table = table.filter(pc.is_valid(table.column("hashes")))
    parts = [from_binary(t.column(c), k)[0] for t in (table, known) for c, k in (("docs", np.int64), ("texts", np.int64), ("counts", np.uint32), ("places", np.uint32))]
    hashes, _ = from_binary(table.column("hashes"), kind)
    return *parts[:4], hashes, found(*parts[4:], np.ones(len(parts[7]), bool))


def found(ids: np.ndarray, texts: np.ndarray, counts: np.ndarray, places: np.ndarray, hit: np.ndarray) -> pa.Table:
    """The marked places, a row for each run of a document."""
    owner = np.repeat(np.arange(len(ids)), counts)[hit]
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    return pa.Table.from_arrays([pa.array(ids[owner[first]]), pa.array(texts[owner[first]]), binary_rows(places[hit], np.append(first, len(owner)))], schema=FOUND)


def dedup_substrings(docs: DataFrame, width: int = 13, period: int = 7, bucket_hashes: int = 1 << 20) -> DataFrame:
    """All documents without the words of windows that also start in a document with a smaller doc_id.

    Takes doc_id and text; further columns are ignored, whatever their names.
    Words are the runs outside `[\\x20\\x09-\\x0D]`. Windows are judged on the
    input. A null text has no words. Rows with the same doc_id are one document
    in the comparison and keep their own texts; a row with a null doc_id is
    neither judged nor held against others. Returns doc_id, n_words, n_removed
    and kept_text (kept words joined by one space), a row for each row; an
    empty table gives none. `bucket_hashes` bounds how many hashes meet in one
    task on average.
    """
    cover = COVERS[period]
    run = width - period + 1
    if run < 1:
        raise ValueError("width must be at least the period")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = base.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A word and its separator take two bytes at least and six as a rule.
    buckets = max(64, -(-size * len(cover) // (6 * period * bucket_hashes)))

    def texts_of(batch):
        """(doc_ids, text_hashes, known, bytes, offsets) of a batch."""
        ids = batch.column("doc_id")
        return np.asarray(ids.fill_null(0)), np.asarray(batch.column("text_hash")), ~np.asarray(ids.is_null()), *string_buffers(batch.column("text"))

    def anchors(batches):
        hasher, in_cover = WordHasher(7), np.zeros(period, bool)
        in_cover[list(cover)] = True
        for batch in batches:
            ids, hashes, known, data, offsets = texts_of(batch)
            packer = Packer(np.uint32, buckets, True)
            for a, b in chunks(offsets):
                words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                position, doc = words.position(), words.doc_of_word()
                usable = words.counts * (known[a:b] & (words.counts >= width))
                at = np.flatnonzero(in_cover[position % period] & (position + run <= usable[doc]))
                value = hasher.windows(hasher.words(words.data, words.starts, words.ends), run)[at]
                packer.add(doc[at] + a, position[at], value % U64(buckets), (value // U64(buckets)) & U64(0xFFFFFFFF))
            yield from packer.batches(ids, hashes)

    def shared(table: pa.Table) -> pa.Table:
        """The anchors whose hash is in at least two documents."""
        ids, texts, counts, places, value, known = unpack(table, np.uint32)
        if not len(value):
            return known
        order = np.argsort(value, kind="stable")
        first = np.flatnonzero(np.diff(value[order].astype(np.int64), prepend=-1))
        owner = np.repeat(ids, counts)[order]
        several = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
        hit = np.zeros(len(value), bool)
        hit[order] = np.repeat(several, np.diff(np.append(first, len(value))))
        return pa.concat_tables([found(ids, texts, counts, places, hit), known])

    def extended(batches):
        """The full windows around shared anchors."""
        hasher, other = WordHasher(11), WordHasher(13)
        for batch in batches:
            lists = batch.column("places")
            some = np.flatnonzero(np.asarray(lists.is_valid()))
            if not len(some):
                continue
            batch = batch.take(pa.array(some))
            ids, hashes, known, data, offsets = texts_of(batch)
            flat, each = _place_lists(batch.column("places"))
            bound = np.concatenate([[0], np.cumsum(each)])
            packer = Packer(np.uint64, buckets, False)
            for a, b in chunks(offsets):
                words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                owner = np.repeat(np.arange(b - a), each[a:b])
                anchor = flat[bound[a] : bound[b]].astype(np.int64)
                last = words.counts[owner] - width
                low, high = np.maximum(anchor - (period - 1), 0), np.minimum(anchor, last)
                lens = np.maximum(high - low + 1, 0)
                marked = np.zeros(len(words.starts), bool)
                marked[expand(low + words.first[owner], lens)] = True
                at = np.flatnonzero(marked)
                bytes_ = (words.data, words.starts, words.ends)
                value, second = hasher.windows(hasher.words(*bytes_), width)[at], other.windows(other.words(*bytes_), width)[at]
                packer.add(words.doc_of_word()[at] + a, words.position()[at], second % U64(buckets), value)
            yield from packer.batches(ids, hashes)

    def later(table: pa.Table) -> pa.Table:
        """The windows that start in a document with a smaller id too."""
        ids, texts, counts, places, value, known = unpack(table, np.uint64)
        if not len(value):
            return known
        order = np.argsort(value, kind="stable")
        ordered = value[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
        owner = np.repeat(ids, counts)[order]
        hit = np.zeros(len(value), bool)
        hit[order] = owner > np.repeat(np.minimum.reduceat(owner, first), np.diff(np.append(first, len(value))))
        return pa.concat_tables([found(ids, texts, counts, places, hit), known])

    def cut(batches):
        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            flat, each = _place_lists(batch.column("places"))
            bound = np.concatenate([[0], np.cumsum(each)])
            for a, b in chunks(offsets):
                words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                removed = np.zeros(len(words.starts) + width, bool)
                begin = flat[bound[a] : bound[b]].astype(np.int64) + np.repeat(words.first[:-1], each[a:b])
                for k in range(width):
                    removed[begin + k] = True
                keep = np.flatnonzero(~removed[: len(words.starts)])
                kept = np.searchsorted(keep, words.first)
                lens = words.ends[keep] - words.starts[keep] + 1
                out = words.data[np.minimum(expand(words.starts[keep], lens), max(0, len(words.data) - 1))]
                ends = np.cumsum(lens)
                out[ends - 1] = 32  # the byte after each word becomes its space
                total = np.concatenate([[0], ends])[kept]
                some = np.diff(kept) > 0
                bounds = np.empty(2 * (b - a), np.int64)  # leave the last space of each document out
                bounds[0::2], bounds[1::2] = total[:-1], total[1:] - some
                text = binary_rows(out, np.append(bounds, total[-1])).take(pa.array(np.arange(0, 2 * (b - a), 2)))
                n = words.counts
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(n), pa.array(n - np.diff(kept)), text.cast(pa.string())], schema=result)

    result = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def beside(rows: DataFrame) -> DataFrame:
        """The documents with their lists of places. Both uses shuffle the texts alike, so Spark does it once."""
        lists = rows.groupBy("doc_id", "text_hash").agg(F.collect_list("places").alias("places"))
        return base.join(lists.hint("merge"), ["doc_id", "text_hash"], "left").select("doc_id", "text_hash", "text", "places")

    recurring = base.mapInArrow(anchors, PACKED_SQL).groupBy("bucket").applyInArrow(shared, FOUND_SQL)
    windows = beside(recurring).mapInArrow(extended, PACKED_SQL)
    doomed = windows.groupBy("bucket").applyInArrow(later, FOUND_SQL)
    return beside(doomed).select("doc_id", "text", "places").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")


def _place_lists(column) -> tuple[np.ndarray, np.ndarray]:
    """(places, number of them for each row) of a column of lists of packed places."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    packs = column.flatten()
    flat, counts = from_binary(packs, np.uint32) if len(packs) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    per_row = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(counts)])
    row_ends = np.concatenate([[0], np.cumsum(per_row)])
    return flat, np.diff(ends[row_ends])
