"""Benchmark decontamination by greedy string tiling.

Texts are cut into words of letters and digits, A-Z lower-cased. Documents and
benchmark items that share a seed (`min_match` words) are candidates; their tiles may be shorter. The tiling
of a pair marks its longest common run of words, then the longest one among
what is left, and so on, each word at most once, so it finds a passage's parts
in whatever order they stand. Common runs are found by rolling hashes of the shortest
length and joined along diagonals. A document is contaminated by an item if the
tiles cover enough of the item's words.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.storage import written
from rillflow.llm.tokens import expand
from rillflow.llm.wordhash import PUNCTUATION, U64, WordHasher, Words, chunks, string_buffers

MATCHES = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("covered", pa.int64()), ("item_words", pa.int64()), ("tiles", pa.int64()), ("longest", pa.int64()), ("coverage", pa.float64())])
MATCHES_SQL = "doc_id long, item_id long, covered long, item_words long, tiles long, longest long, coverage double"


def tile(doc_at: np.ndarray, item_at: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, place in the item, place in the document) from the places of equal seeds; the longest first."""
    diagonal = doc_at - item_at
    order = np.lexsort((doc_at, diagonal))
    doc_at, item_at, diagonal = doc_at[order], item_at[order], diagonal[order]
    new = np.append(True, (np.diff(diagonal) != 0) | (np.diff(doc_at) != 1))
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(new))) + seed - 1
    heap = [(-n, q, p) for n, q, p in zip(length.tolist(), item_at[first].tolist(), doc_at[first].tolist())]
    heapq.heapify(heap)
    used_doc: set[int] = set()
    used_item: set[int] = set()
    tiles = []
    while heap:
        n, q, p = heapq.heappop(heap)
        n = -n
        free = [q + k not in used_item and p + k not in used_doc for k in range(n)]
        if all(free):
            tiles.append((n, q, p))
            used_item.update(range(q, q + n))
            used_doc.update(range(p, p + n))
            continue
        k = 0
        while k < n:  # the parts that no tile covers yet
            if not free[k]:
                k += 1
                continue
            end = k
            while end < n and free[end]:
                end += 1
            if end - k >= seed:
                heapq.heappush(heap, (k - end, q + k, p + k))
            k = end
    return tiles


class Items:
    """Benchmark items with the places of their seeds, sorted by hash."""

    def __init__(self, ids: list[int], texts: list[str], seed: int, shortest: int):
        self.seed, self.shortest, self.hasher = seed, min(seed, shortest), WordHasher(23, lower=True)
        data, offsets = string_buffers(pa.array(texts, pa.string()))
        words = Words(data, offsets, PUNCTUATION)
        self.ids, self.counts = np.asarray(ids, np.int64), words.counts
        each = self.hasher.words(data, words.starts, words.ends)
        value = self.hasher.windows(each, seed)
        position, item = words.position(), words.doc_of_word()
        self.words = [each[words.first[i] : words.first[i + 1]] for i in range(len(ids))]
        # Items under a seed count as a whole: their hash and number, by length.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(self.shortest, seed):
            if len(own := np.flatnonzero(words.counts == n)):
                whole = self.hasher.windows(each, n)[words.first[own]]
                order = np.argsort(whole, kind="stable")
                self.short[n] = whole[order], own[order]
        at = np.flatnonzero(position + seed <= words.counts[item])
        order = at[np.argsort(value[at], kind="stable")]
        self.value, self.item, self.place = value[order], item[order], position[order]

    def matches(self, doc_ids: pa.Array, column: pa.Array, coverage: float):
        """Lists of matches of the documents of a batch with the items."""
        data, offsets = string_buffers(column)
        known = np.asarray(doc_ids.is_valid())
        for a, b in chunks(offsets):
            words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], PUNCTUATION)
            each = self.hasher.words(words.data, words.starts, words.ends)
            small = self.hasher.windows(each, self.shortest)
            yield from self._whole(doc_ids, a, words, each)
            value = self.hasher.windows(each, self.seed)
            low = np.searchsorted(self.value, value)
            hit = np.flatnonzero(self.value[np.minimum(low, len(self.value) - 1)] == value) if len(self.value) else low[:0]
            doc, position = words.doc_of_word(), words.position()
            hit = hit[position[hit] + self.seed <= words.counts[doc[hit]]]
            if not len(hit):
                continue
            lens = np.searchsorted(self.value, value[hit], "right") - low[hit]
            seeds = expand(low[hit], lens)
            hit = np.repeat(hit, lens)
            # Candidates share a seed; their tiles may be as short as `shortest`.
            for one in np.unique(doc[hit] * len(self.ids) + self.item[seeds]):
                i, item = divmod(int(one), len(self.ids))
                if not known[a + i]:
                    continue
                n = int(self.counts[item])
                x = words.first[i]
                at, place = self._common(small[x : x + words.counts[i] - self.shortest + 1], item)
                reach = np.zeros(n + self.shortest, bool)
                for k in range(self.shortest):
                    reach[place + k] = True
                if reach.sum() < coverage * n - 1e-9:
                    continue  # no tiling covers more than all common runs do
                tiles = tile(at, place, self.shortest)
                covered = sum(t[0] for t in tiles)
                if covered >= coverage * n - 1e-9:
                    yield doc_ids[a + i].as_py(), int(self.ids[item]), covered, n, len(tiles), tiles[0][0], covered / n

    def _common(self, small: np.ndarray, item: int):
        """The places (document, item) of equal runs of `shortest` words."""
        own = self.hasher.windows(self.words[item], self.shortest)[: max(0, int(self.counts[item]) - self.shortest + 1)]
        order = np.argsort(own, kind="stable")
        low = np.searchsorted(own[order], small)
        lens = np.searchsorted(own[order], small, "right") - low
        return np.repeat(np.arange(len(small)), lens), order[expand(low, lens)]

    def _whole(self, doc_ids: pa.Array, a: int, words: Words, each: np.ndarray):
        """Matches of items under a seed: all their words in a row."""
        doc, position = words.doc_of_word(), words.position()
        for n, (whole, own) in self.short.items():
            value = self.hasher.windows(each, n)
            at = np.flatnonzero(position + n <= words.counts[doc])
            at = at[np.isin(value[at], whole)]
            low = np.searchsorted(whole, value[at])
            lens = np.searchsorted(whole, value[at], "right") - low
            for one in np.unique(np.repeat(doc[at], lens) * len(self.ids) + own[expand(low, lens)]):
                i, item = divmod(int(one), len(self.ids))
                if doc_ids[a + i].is_valid:
                    yield doc_ids[a + i].as_py(), int(self.ids[item]), n, n, 1, n, 1.0


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), MATCHES.types)], schema=MATCHES)


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.8, min_match: int = 5, max_bytes: int = 16 << 20, min_tile: int = 2) -> DataFrame:
    """Pairs of a document and a benchmark item whose words the tiles cover by `coverage` or more.

    Takes doc_id and text of `docs`, item_id and text of `benchmark`; further
    columns are ignored. Candidates share a run of `min_match` words, and tiles
    have `min_tile` words at least. An item of fewer than `min_match` words matches
    as a whole; texts that are null or under `min_tile` words match nothing; rows with a null id are left out. A pair is returned
    once, with its best coverage, however often its rows are repeated. Empty
    tables give no pair. Words are compared by hashes of 64 bits; of equally long
    common runs the one that is first in the item, then in the document, is
    marked first. Items go to the executors in blocks of about `max_bytes` of text;
    the documents are read once for each block.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // max(1, max_bytes)))
    found = None
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # about max_bytes of text
        if own or found is None:
            here = base.mapInArrow(_matcher([r[0] for r in own], [r[1] for r in own], min_match, min_tile, coverage), MATCHES_SQL)
            if blocks > 1:
                here = written(here, "matches", narrow=True)  # the driver holds one block at a time
            found = here if found is None else found.union(here)
    best = F.max(F.struct("covered", "item_words", F.negative("tiles").alias("t"), "longest", "coverage")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "best.covered", "best.item_words", F.negative("best.t").alias("tiles"), "best.longest", "best.coverage"
    )


def _matcher(ids: list[int], texts: list[str], seed: int, shortest: int, coverage: float):
    def match(batches):
        known = Items(ids, texts, seed, shortest)
        for batch in batches:
            if found := list(known.matches(batch.column(0), batch.column(1), coverage)):
                yield _batch(found)

    return match


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """`docs` without the documents that `benchmark_matches` finds, all columns.

    All rows of a found doc_id go; rows with a null id, which no match names,
    and rows with a null or empty text stay. Repeated rows stay or go together.
    """
    hits = benchmark_matches(docs, benchmark, **options).select(F.col("doc_id").alias("hit")).distinct()
    return docs.join(hits, docs["doc_id"] == hits["hit"], "left_anti")
