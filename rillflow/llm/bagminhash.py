"""Near-duplicate documents by BagMinHash signatures, banding and exact overlap.

A document is the multiset of its word shingles. BagMinHash (Ertl, 2018) gives
each shingle Poisson processes over its discretised weight: one process for the
weight range (0, 1], one for (1, 2], (2, 4], (4, 8] and so on, each of rate equal
to the width of its range. A point of a process has a time, a place in the range
and a signature component; it counts for a document if its place is below the
shingle's weight there. A component's value is its earliest point, so two
signatures agree in a component with the probability of the weighted Jaccard
similarity. Points are made in the order of time and only up to the time by
which all components are filled, so a document costs little more than its
shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.components import connected_components
from rillflow.llm.storage import Scratch, written
from rillflow.llm.tokens import expand
from rillflow.llm.wordhash import U64, WordHasher, Words, binary_rows, chunks, mix64, string_buffers

LOW48 = U64((1 << 48) - 1)
#: Shingle counts are summed in so many cells by hash; a cell of FULL or more is kept as FULL.
CELLS, FULL = 256, 255


def shingle_multisets(data: np.ndarray, offsets: np.ndarray, width: int, hasher: WordHasher):
    """(document, shingle hash of 48 bits, count), ordered by document and hash.

    A document of fewer than `width` words, but one at least, has one shingle: all its words.
    """
    words = Words(data, offsets)
    each = hasher.words(words.data, words.starts, words.ends)
    position, doc = words.position(), words.doc_of_word()
    at = np.flatnonzero(position + width <= words.counts[doc])
    key = (doc[at].astype(U64) << U64(48)) | (hasher.windows(each, width)[at] & LOW48)
    short = np.flatnonzero((words.counts > 0) & (words.counts < width))
    for i in short:
        own = each[words.first[i] : words.first[i + 1]]
        value = hasher.windows(own, len(own)) + U64(len(own))
        key = np.append(key, (U64(i) << U64(48)) | (value[0] & LOW48))
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(key)))
    return (key[first] >> U64(48)).astype(np.int64), key[first] & LOW48, counts


def signatures(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """BagMinHash signatures, a row of `m` 64-bit values a document; documents without shingles have zeros."""
    out = np.zeros((n_docs, m), U64)
    weight = np.bincount(doc, count, n_docs)
    todo = weight > 0
    reach = (np.log(m) + 3.0) * m / np.maximum(weight, 1)
    while todo.any():
        own = todo[doc] if not todo.all() else np.ones(len(doc), bool)
        filled = _fill(out, doc[own], shingle[own], count[own], reach, m)
        todo &= filled < m
        reach = np.where(todo, reach * 2, reach)
    return out


def _fill(out: np.ndarray, doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, reach: np.ndarray, m: int) -> np.ndarray:
    """Signatures from all points up to each document's time; returns how many components are filled."""
    ranges = np.where(count > 1, np.ceil(np.log2(count)).astype(np.int64) + 1, 1)
    e = np.repeat(np.arange(len(doc)), ranges)
    level = np.arange(len(e)) - np.repeat(np.cumsum(ranges) - ranges, ranges)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    width = np.where(level == 0, 1, low)
    d, top = doc[e], count[e]
    state = mix64((shingle[e] << U64(6)) + level.astype(U64))
    last, time = reach[d], np.zeros(len(e))
    points: list[tuple] = []
    while len(d):
        state = mix64(state + U64(0x9E3779B97F4A7C15))
        # 2**-53 keeps the logarithm finite.
        time = time - np.log(((state >> U64(11)).astype(np.float64) + 1.0) * 2.0**-53) / width
        live = time <= last
        state, time, last, d, low, width, top = (x[live] for x in (state, time, last, d, low, width, top))
        mark = mix64(state ^ U64(0xD1B54A32D192ED03))
        place = low + ((mark >> U64(40)).astype(np.float64) * 2.0**-24 * width).astype(np.int64)
        ok = place < top
        points.append((d[ok] * m + (mark[ok] & U64(0xFFFFFFFF)).astype(np.int64) % m, time[ok], mark[ok]))
    slot, time, mark = (np.concatenate(x) for x in zip(*points))
    order = np.argsort(-time)  # of several writes to a place the last one stays: the earliest point
    slot = slot[order]
    flat = out.reshape(-1)
    flat[slot] = mark[order] | U64(1)
    return np.bincount(np.unique(slot) // m, minlength=len(out))


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of consecutive components."""
    n, m = signature.shape
    rows = m // bands
    parts = signature[:, : bands * rows].reshape(n, bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=U64) * U64(0x9E3779B97F4A7C15), (n, bands)).copy()
    for k in range(rows):
        key = mix64(key.reshape(-1) ^ parts[:, :, k].reshape(-1)).reshape(n, bands) * U64(0x2545F4914F6CDD1D)
    return key.view(np.int64)


SIGNED = pa.schema([("doc_id", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("weight", pa.int64()), ("keys", pa.list_(pa.int64())), ("sketch", pa.binary())])


def sign_documents(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, c1, c2, weight, keys, sketch): a 128-bit hash of the shingle multiset, its size, band keys, and 16 bits of each component with the shingle counts by cell."""
    m = bands * rows

    def sign(batches):
        hasher = WordHasher(17, lower=True)
        for batch in batches:
            data, offsets = string_buffers(batch.column(1))
            for a, b in chunks(offsets, 2 << 20):
                for a, b in ((x, min(b, x + 60000)) for x in range(a, b, 60000)):  # 16 bits name a document in a chunk
                    n = b - a
                    doc, shingle, count = shingle_multisets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width, hasher)
                    own = mix64(shingle ^ mix64(count.astype(U64)))
                    sums = np.zeros((2, n), U64)
                    first = np.flatnonzero(np.diff(doc, prepend=-1))
                    if len(first):
                        sums[0, doc[first]] = np.add.reduceat(own, first)
                        sums[1, doc[first]] = np.add.reduceat(mix64(own + U64(0x632BE59BD9B4E019)), first)
                    signature = signatures(doc, shingle, count, n, m)
                    keys = band_keys(signature, bands)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1)))
                    cells = np.bincount(doc * CELLS + (shingle & U64(CELLS - 1)).astype(np.int64), count, n * CELLS).reshape(n, CELLS)
                    both = np.concatenate([(signature >> U64(48)).astype(np.uint16).view(np.uint8).reshape(n, -1), np.minimum(cells, FULL).astype(np.uint8)], 1)
                    sketch = binary_rows(both.reshape(-1), np.arange(n + 1) * both.shape[1])
                    weight = np.bincount(doc, count, n).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(weight), lists, sketch], schema=SIGNED)

    return docs.mapInArrow(sign, "doc_id long, c1 long, c2 long, weight long, keys array<long>, sketch binary")


def gram_lists(texts: DataFrame, width: int) -> DataFrame:
    """(node, grams): 16 bits of each shingle of a text, as often as it stands there, in order; texts without words are left out."""

    def run(batches):
        hasher = WordHasher(17, lower=True)
        for batch in batches:
            data, offsets = string_buffers(batch.column(1))
            for a, b in chunks(offsets, 4 << 20):
                for a, b in ((x, min(b, x + 60000)) for x in range(a, b, 60000)):
                    doc, shingle, count = shingle_multisets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width, hasher)
                    key = np.repeat((doc.astype(U64) << U64(16)) | (shingle & U64(0xFFFF)), count)
                    key.sort()
                    some = np.unique(doc)
                    first = np.searchsorted(key >> U64(16), some.astype(U64))
                    lists = binary_rows((key & U64(0xFFFF)).astype("<u2"), np.append(first, len(key)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some + a)), lists.cast(pa.binary())], names=["node", "grams"])

    return texts.select("doc_id", "text").mapInArrow(run, "node long, grams binary")


class Grams:
    """The gram lists of a block of nodes, with the number of each 16-bit value."""

    def __init__(self, lists: list[bytes]):
        self.weight = np.array([len(g) // 2 for g in lists], np.int64)
        flat = np.frombuffer(b"".join(lists), "<u2")
        row = np.repeat(np.arange(len(lists)), self.weight)
        first = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (flat[1:] != flat[:-1])))
        self.value, self.count = flat[first], np.diff(np.append(first, len(flat)))
        self.start = np.searchsorted(row[first], np.arange(len(lists) + 1))

    def most(self, x: int, others: np.ndarray) -> np.ndarray:
        """The most shingles that the multiset of node x can share with those of `others`."""
        own = np.zeros(1 << 16, np.int64)
        own[self.value[self.start[x] : self.start[x + 1]]] = self.count[self.start[x] : self.start[x + 1]]
        n = self.start[others + 1] - self.start[others]
        at = expand(self.start[others], n)
        return np.add.reduceat(np.minimum(own[self.value[at]], self.count[at]), np.cumsum(n) - n)


def verify_pairs(pairs: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingle multisets overlap by `threshold` or more; `texts` has a text for each id."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")

    def verify(batches):
        hasher = WordHasher(17, lower=True)
        for batch in batches:
            sides = [string_buffers(batch.column(k)) for k in (2, 3)]
            longest = sides[0][1] + sides[1][1]
            passed = np.zeros(batch.num_rows, bool)
            for a, b in chunks(longest, 4 << 20):
                for a, b in ((x, min(b, x + 60000)) for x in range(a, b, 60000)):
                    sets = []
                    for data, offsets in sides:
                        doc, shingle, count = shingle_multisets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width, hasher)
                        sets.append(((doc.astype(U64) << U64(48)) | shingle, count))
                    common, i, j = np.intersect1d(sets[0][0], sets[1][0], assume_unique=True, return_indices=True)
                    n = b - a
                    shared = np.bincount((common >> U64(48)).astype(np.int64), np.minimum(sets[0][1][i], sets[1][1][j]), n)
                    total = sum(np.bincount((s >> U64(48)).astype(np.int64), c, n) for s, c in sets) - shared
                    passed[a:b] = shared >= threshold * total - 1e-9
                    passed[a:b] &= total > 0
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(passed)) for k in (0, 1)], names=["a", "b"])

    return both.mapInArrow(verify, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    threshold: float = 0.8,
    width: int = 5,
    bands: int = 30,
    rows: int = 5,
    block: int = 4000,
    broadcast_ids: int = 4_000_000,
) -> DataFrame:
    """(doc_id, class_id) of all documents: classes of near-duplicates, named by their smallest doc_id.

    Two documents are linked if the multisets of their shingles (`width`
    consecutive words, A-Z lower-cased) have a weighted Jaccard similarity of
    `threshold` or more; classes are the connected components. A pair at 0.8
    shares none of 30 bands of 5 with a probability under 1e-5. A document of
    fewer than `width` words has one shingle, all its words. A null text, or one
    without words, is a class of its own document. Rows with the same doc_id
    are one document, linked by each of its texts; rows with a null doc_id are
    left out. Further columns are ignored. An empty table gives no row.

    Documents with equal multisets are one node. In each bucket of a band all
    nodes are first held against the smallest; then, where a bucket still holds
    several classes, its nodes are compared in blocks of `block` by sketch. Pairs
    of different classes are verified in two rounds: the likeliest partners of
    each node, then all whose counts by cell and 16-bit shingles let them reach the
    threshold, which are bounds that no link misses. So large groups cost about
    their size in verified pairs, and no link of a bucket between different classes is lost to a limit.
    """
    base = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scratch = Scratch(docs.sparkSession)
    signed = scratch.write(sign_documents(base, width, bands, rows), "snappy")
    solid = signed.where("weight > 0")
    named = solid.groupBy("c1", "c2").agg(F.min("doc_id").alias("node"))
    paired = solid.join(named, ["c1", "c2"])
    nodes = scratch.write(paired.where("doc_id = node").dropDuplicates(["c1", "c2"]).select("node", "weight", "keys", "sketch"), "snappy")
    same = scratch.write(paired.select("doc_id", "node").distinct(), narrow=True)
    buckets = nodes.select("node", "weight", F.posexplode("keys").alias("band", "key"))
    sizes = buckets.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader")).where("n > 1")
    members = scratch.write(buckets.join(sizes, ["band", "key"]).select("band", "key", "node", "weight", "n", "leader"), "snappy", narrow=True)
    met = members.select(F.col("node").alias("doc_id")).distinct()
    # The ids of the nodes that share a bucket: 8 bytes each.
    texts = scratch.write(base.join(F.broadcast(met) if met.count() <= broadcast_ids else met, "doc_id", "left_semi"))
    first = members.where("node <> leader").groupBy(F.col("node").alias("b")).agg(F.min("leader").alias("a")).select("a", "b")
    ends = same.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z")
    tested = scratch.write(first, narrow=True)
    edges = scratch.write(verify_pairs(tested, texts, width, threshold).union(same.join(ends, "doc_id").select("a", F.col("node").alias("b"))), narrow=True)
    component = connected_components(edges, scratch)
    m = bands * rows
    # The last round has no limit of the sketch: a pair that shares a bucket is left out by exact bounds only.
    limits = [(threshold * m, 2), (0, None)]
    for least, ranks in limits:
        known = nodes if ranks else (nodes, gram_lists(texts, width))
        pairs = scratch.write(_rest(members, known, component, threshold, bands, rows, block, least, ranks).join(tested, ["a", "b"], "left_anti"), narrow=True)
        if pairs.limit(1).count():
            tested = tested.union(pairs)
            edges = scratch.write(edges.union(verify_pairs(pairs, texts, width, threshold)), narrow=True)
            component = connected_components(edges, scratch)
    classes = same.join(component, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "node")).alias("class_id"))
    blank = signed.where("weight = 0").select("doc_id").distinct().join(same, "doc_id", "left_anti")
    result = written(classes.union(blank.select("doc_id", "doc_id")), "classes", narrow=True)
    scratch.close()
    return result


def _rest(members: DataFrame, nodes: DataFrame | tuple[DataFrame, DataFrame], component: DataFrame, threshold: float, bands: int, rows: int, block: int, least: float, ranks: int | None) -> DataFrame:
    """Pairs (a, b) of different classes that share a bucket and agree in `least` components or more.

    In a bucket every node outside its largest class is a probe; it meets all
    nodes of the bucket, block by block, and gives its `ranks` likeliest
    partners of a block, or all. A pair that shares several bands is given for
    the first of them, and none whose counts by cell, or gram lists if they come
    with the nodes, rule the threshold out.
    """
    nodes, lists = nodes if isinstance(nodes, tuple) else (nodes, None)
    m = bands * rows
    classed = members.join(component, "node", "left").select("band", "key", "node", "weight", "n", F.coalesce("component", "node").alias("class"))
    sizes = classed.groupBy("band", "key", "class").agg(F.count(F.lit(1)).alias("size"))
    mixed = sizes.groupBy("band", "key").agg(F.max(F.struct("size", "class")).alias("main"), F.count(F.lit(1)).alias("classes"), F.sum("size").alias("all"))
    mixed = mixed.where("classes > 1").select("band", "key", F.col("main.class").alias("main"), (F.col("all") - F.col("main.size")).alias("others"))
    rest = classed.join(mixed, ["band", "key"])
    probe_blocks, base_blocks = (F.ceil(F.col(c) / block).cast("int") for c in ("others", "n"))

    def place(count):
        return F.pmod(F.xxhash64("node"), count).cast("int")

    def every(count):
        return F.explode(F.sequence(F.lit(0), count - 1))

    columns = ["band", "key", "node", "weight", "class"]
    probes = rest.where("class <> main").select(*columns, F.lit(True).alias("probe"), place(probe_blocks).alias("i"), every(base_blocks).alias("j"))
    bases = rest.select(*columns, F.lit(False).alias("probe"), every(probe_blocks).alias("i"), place(base_blocks).alias("j"))
    spread = probes.union(bases).join(nodes.select("node", "sketch"), "node")
    listed = lists is not None
    if listed:
        spread = spread.join(lists.join(rest.select("node").distinct(), "node", "left_semi"), "node")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(table: pa.Table) -> pa.Table:
        node, weight, cls, probe = (np.asarray(table.column(k).combine_chunks()) for k in ("node", "weight", "class", "probe"))
        both = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(node), -1)
        sketch, cells = np.ascontiguousarray(both[:, : 2 * m]).view(np.uint16), both[:, 2 * m :]
        full = cells.max(1) == FULL
        grams = Grams(table.column("grams").to_pylist()) if listed else None
        band = table.column("band")[0].as_py()
        base = np.flatnonzero(~probe)
        base = base[np.argsort(node[base])]
        out = [np.zeros((0, 2), np.int64)]
        for x in np.flatnonzero(probe):
            y = base[(cls[base] != cls[x]) & (np.minimum(weight[base], weight[x]) >= threshold * np.maximum(weight[base], weight[x]) - 1e-9)]
            same = sketch[y] == sketch[x]
            agree = same.sum(1)
            some = np.flatnonzero(agree >= least)
            if not len(some):
                continue
            earlier = same[some, : band * rows].reshape(len(some), band, rows).all(2).any(1)
            some = some[~earlier]
            # No overlap is larger than the sum of the smaller counts of each cell.
            most = np.minimum(cells[y[some]], cells[x]).sum(1, dtype=np.int64)
            could = most >= threshold * (weight[y[some]] + weight[x] - most) - 1e-9
            some = some[could | full[y[some]] | full[x]]
            if grams is not None and len(some):
                most = grams.most(x, y[some])
                some = some[most >= threshold * (grams.weight[y[some]] + grams.weight[x] - most) - 1e-9]
            other = node[y[some[np.argsort(-agree[some], kind="stable")][:ranks]]]
            out.append(np.stack([np.minimum(node[x], other), np.maximum(node[x], other)], 1))
        pairs = np.unique(np.concatenate(out), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]}, schema=schema)

    return spread.groupBy("band", "key", "i", "j").applyInArrow(compare, "a long, b long").distinct()
