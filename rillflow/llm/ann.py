"""Approximate nearest neighbours by multiprobe p-stable hashing.

The largest inner product becomes the smallest Euclidean distance by one more
component: sqrt(M^2 - |x|^2) for a candidate, 0 for a query scaled to the length
M of the longest vector. A table hashes a vector by some random Gaussian
projections, cut into cells of `width` times M (p-stable hashing). A query
visits, in each table, its own bucket and those of its neighbours in the order
in which they are expected to hold near vectors (multi-probe LSH, Lv et al.,
2007). The candidates of all tables are merged, each once, and ranked by the
exact product.

The index lies in shards of bounded size, dealt by hash, so a full bucket is
spread over all of them. A block of queries meets a shard in one task, which
hashes the shard's vectors, visits their buckets and returns each query's best:
vectors travel once for each block, pairs never do.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillflow.llm.storage import Scratch, written
from rillflow.llm.tokens import expand


def probe_sets(projections: int, count: int) -> list[tuple[int, ...]]:
    """The first `count` sets of cell borders to cross, by expected squared distance; border j is the j-th nearest of 2 * projections."""
    m = projections
    expected = [j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    expected += [1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(m + 1, 2 * m + 1)]
    heap, sets = [(expected[0], (0,))], [()]
    while heap and len(sets) < count:
        cost, borders = heapq.heappop(heap)
        if all(2 * m - 1 - j not in borders for j in borders):  # not both borders of one projection
            sets.append(borders)
        last = borders[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (cost - expected[last] + expected[last + 1], borders[:-1] + (last + 1,)))
            heapq.heappush(heap, (cost + expected[last + 1], borders + (last + 1,)))
    return sets


class Tables:
    """The random projections of all tables; the same on every executor."""

    def __init__(self, dim: int, longest: float, tables: int, projections: int, width: float, probes: int, seed: int = 31):
        rng = np.random.default_rng(seed)
        self.tables, self.m, self.longest = tables, projections, longest
        self.a = rng.normal(size=(tables, dim + 1, projections)) / (width * longest)
        self.b = rng.random((tables, projections))
        self.mixer = rng.integers(1, 2**62, (tables, projections))
        self.sets = probe_sets(projections, probes)

    def codes(self, x: np.ndarray, t: int) -> np.ndarray:
        """Bucket codes of candidates."""
        rest = np.sqrt(np.maximum(self.longest**2 - (x * x).sum(1), 0))
        cells = np.floor(np.concatenate([x, rest[:, None]], 1) @ self.a[t] + self.b[t]).astype(np.int64)
        return (cells * self.mixer[t]).sum(1)

    def probes(self, q: np.ndarray, t: int) -> np.ndarray:
        """Bucket codes that each query visits, the likeliest first; a row a query."""
        scaled = q * (self.longest / np.sqrt((q * q).sum(1)))[:, None]
        at = scaled @ self.a[t, :-1] + self.b[t]
        cells = np.floor(at).astype(np.int64)
        near = np.concatenate([at - cells, 1 - (at - cells)], 1)
        order = np.argsort(near, 1)
        code = (cells * self.mixer[t]).sum(1)
        step = np.where(order < self.m, -1, 1) * self.mixer[t][order % self.m]
        out = np.empty((len(q), len(self.sets)), np.int64)
        for k, borders in enumerate(self.sets):
            out[:, k] = code + step[:, list(borders)].sum(1)
        return out


def vectors_of(column: pa.Array) -> np.ndarray:
    values = column.flatten()
    return np.asarray(values).astype(np.float64).reshape(len(column), -1)


def in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The inner products of the rows of two arrays, each summed from the first component to the last."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * y[:, j]
    return out


def best_of(points: np.ndarray, own: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the `k` points with the largest products with `q`; ties go to the smaller id."""
    rough = points @ q
    if len(rough) > k:
        # A product by blocks may differ from the one in order in its last bits.
        least = np.partition(rough, len(rough) - k)[len(rough) - k]
        near = np.flatnonzero(rough >= least - 1e-12 * (1 + np.abs(rough).max()))
        points, own = points[near], own[near]
    score = in_order(points, np.broadcast_to(q, points.shape))
    best = np.lexsort((own, -score))[:k]
    return own[best], score[best]


def visited(known: Tables, points: np.ndarray, queries: np.ndarray, index: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Which points each query meets in the buckets that it visits, a row a query."""
    mark = np.zeros(len(queries) * len(points), bool)
    for t, (order, codes) in enumerate(index):
        wanted = known.probes(queries, t).reshape(-1)
        low = np.searchsorted(codes, wanted)
        n = np.searchsorted(codes, wanted, "right") - low
        row = np.repeat(np.arange(len(wanted)) // len(known.sets), n)
        mark[row * len(points) + order[expand(low, n)]] = True
    return mark.reshape(len(queries), len(points))


def indexed(known: Tables, points: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(order, sorted codes) of the points in each table."""
    codes = [known.codes(points, t) for t in range(known.tables)]
    orders = [np.argsort(c, kind="stable") for c in codes]
    return [(o, c[o]) for o, c in zip(orders, codes)]


def choose_projections(shape: tuple, queries: np.ndarray, near: np.ndarray, owner: np.ndarray, ladder: range, recall: float) -> int:
    """The most projections of `ladder` with which the sample's queries meet `recall` of their true nearest; the fewest if none does.

    `near`: the true nearest of all queries, `owner`: the query of each.
    """
    for m in reversed(ladder):
        known = Tables(shape[0], shape[1], shape[2], m, *shape[3:])
        met = np.zeros(len(near), bool)
        for t in range(known.tables):
            met |= (known.probes(queries, t)[owner] == known.codes(near, t)[:, None]).any(1)
        if met.mean() >= recall:
            return m
    return ladder[0]


FOUND = pa.schema([("query", pa.int64()), ("cls", pa.int64()), ("score", pa.float64())])
FOUND_SQL = "query long, cls long, score double"


def search(classes: DataFrame, asking: DataFrame, known_of, k: int, shards: int, blocks: int) -> DataFrame:
    """(query, cls, score): the `k` best classes of each class of `asking` in each shard, by the index of `known_of`, or of all if it is None."""
    points = classes.select("cls", "embedding", F.lit(False).alias("asks"), F.pmod(F.xxhash64("cls"), F.lit(shards)).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("j"))
    asked = asking.select("cls", "embedding", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("i"), F.pmod(F.xxhash64(F.lit(1), "cls"), F.lit(blocks)).cast("int").alias("j"))

    def run(table: pa.Table) -> pa.Table:
        cls, asks = (np.asarray(table.column(c).combine_chunks()) for c in ("cls", "asks"))
        x = vectors_of(table.column("embedding").combine_chunks())
        own = np.flatnonzero(~asks)
        own = own[np.argsort(cls[own])]
        points, ids = x[own], cls[own]
        known = known_of() if known_of else None
        index = indexed(known, points) if known else None
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        queries = np.flatnonzero(asks) if len(points) else []
        for a in range(0, len(queries), 64):
            some = queries[a : a + 64]
            mark = visited(known, points, x[some], index) if known else np.ones((len(some), len(points)), bool)
            for q, met in zip(some, mark):
                at = np.flatnonzero(met)
                found, score = best_of(points[at], ids[at], x[q], k)
                out.append((np.full(len(found), cls[q]), found, score))
        return pa.table([np.concatenate(c) for c in zip(*out)], schema=FOUND)

    return points.union(asked).groupBy("i", "j").applyInArrow(run, FOUND_SQL)


def nearest(
    embeddings: DataFrame,
    k: int = 20,
    every: int = 20,
    tables: int = 20,
    width: float = 2.7,
    probes: int = 256,
    recall: float = 0.95,
    sample: int = 64,
    shard_bytes: int = 64 << 20,
) -> DataFrame:
    """The `k` candidates with the largest inner products found for each query: query_id, rank, vec_id, score.

    Takes vec_id and embedding; further columns are ignored. Queries are the
    rows whose vec_id is divisible by `every`, candidates all rows with another
    vec_id; ranks are by score, ties by the smaller vec_id. A score is the sum of
    the products in the order of the components. Rows with a null id, a null or
    zero vector, or one that holds null or non-finite components, or whose
    length isn't the commonest, take no part. Repeated rows count once; of
    several vectors of one vec_id that with the smallest hash is taken. An empty
    table gives none. A query gets `k` rows, or all candidates if they are fewer:
    one whose buckets hold too few is held against every vector.

    The number of projections is the largest, from 6 to 28, with which `sample`
    queries (a documented bound; those with the smallest hashes) meet `recall`
    of their true nearest, which one pass over all vectors finds. Every vector
    is indexed. Equal vectors are searched once and as one candidate that stands
    for its k + 1 smallest ids; no other can be among the k nearest. A shard
    holds about `shard_bytes` of vectors.
    """
    spark = embeddings.sparkSession
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    base = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(good)
    empty = spark.range(0).selectExpr("id AS query_id", "CAST(id AS INT) AS rank", "id AS vec_id", "CAST(id AS DOUBLE) AS score")
    shape = base.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("square")).orderBy(F.desc("n"), "d").first()
    if shape is None:
        return empty
    scratch = Scratch(spark)
    base = base.where(F.size("embedding") == shape["d"])
    base = base.select("vec_id", "embedding", F.xxhash64("embedding").alias("v1"), F.xxhash64(F.lit(1), "embedding").alias("v2"))
    ids = scratch.write(base.groupBy("vec_id").agg(F.min(F.struct("v1", "v2")).alias("v")).select("vec_id", "v.*"), narrow=True)
    first = ids.withColumn("n", F.row_number().over(Window.partitionBy("v1", "v2").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    owner = first.where("n = 1").select(F.col("vec_id").alias("cls"), "v1", "v2")
    members = first.join(owner, ["v1", "v2"]).select("cls", "vec_id")
    asked = scratch.write(ids.where(F.col("vec_id") % every == 0).join(owner, ["v1", "v2"]).select(F.col("vec_id").alias("query_id"), "cls"), narrow=True)
    whole = base.join(owner.withColumnRenamed("cls", "vec_id"), ["vec_id", "v1", "v2"], "left_semi").dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("cls"), "embedding")
    classes = scratch.write(whole.join(asked.select("cls").distinct().withColumn("asks", F.lit(True)), "cls", "left").select("cls", "embedding", F.coalesce("asks", F.lit(False)).alias("asks")))
    asking = classes.where("asks").select("cls", "embedding")
    n, n_asking = classes.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    if not n_asking:
        scratch.close()
        return empty
    fits = max(1000, shard_bytes // (8 * shape["d"]))
    shards = max(-(-n // fits), min(spark.sparkContext.defaultParallelism, -(-n // 2000)))
    blocks = -(-n_asking // fits)

    def best(found: DataFrame, limit: int) -> DataFrame:
        order = Window.partitionBy("query").orderBy(F.desc("score"), "cls")
        return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).drop("n")

    longest = max(shape["square"], 1e-300) ** 0.5
    asks = asking.orderBy(F.xxhash64("cls"), "cls").limit(sample)
    true = best(search(classes, asks, None, k + 1, shards, 1), k + 1).where("query <> cls").join(classes.select("cls", F.col("embedding").alias("near")), "cls")
    both = true.join(classes.select(F.col("cls").alias("query"), "embedding"), "query").select("query", "embedding", "near").toArrow()  # `sample` * (k + 1) pairs of vectors
    kind, m = (shape["d"], longest, tables, width, probes), 6
    if both.num_rows:
        _, place, owner = np.unique(np.asarray(both.column("query").combine_chunks()), return_index=True, return_inverse=True)
        m = choose_projections(kind, vectors_of(both.column("embedding").combine_chunks())[place], vectors_of(both.column("near").combine_chunks()), owner, range(6, 29), recall)

    def answers(found: DataFrame) -> DataFrame:
        each = best(found, k + 1).join(members, "cls").select("query", "vec_id", "score")
        pairs = asked.join(each, asked["cls"] == each["query"]).where("vec_id <> query_id")
        of_id = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return pairs.select("query_id", F.row_number().over(of_id).cast("int").alias("rank"), "vec_id", "score", "cls").where(F.col("rank") <= k)

    got = written(answers(search(classes, asking, lambda: Tables(*kind[:3], m, *kind[3:]), k + 1, shards, blocks)), "nearest", narrow=True)
    most = min(k, ids.count() - 1)
    short = asked.join(got.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < most).select("query_id", "cls")
    result = got.drop("cls")
    if most and (n_short := short.select("cls").distinct().count()):
        rest = search(classes, asking.join(short, "cls", "left_semi"), None, k + 1, shards, -(-n_short // fits))
        more = answers(rest).join(short, "query_id", "left_semi").drop("cls")
        result = written(result.join(short, "query_id", "left_anti").union(more), "nearest", narrow=True)
    scratch.close()
    return result
