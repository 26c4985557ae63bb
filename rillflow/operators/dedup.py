"""Exact groups, similarity joins and representatives."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.operators.lineage import cut


def exact_groups(items: DataFrame, key: str, id_column: str) -> DataFrame:
    """(key, members, first) of each key that at least two items share; null keys share nothing."""
    # A condition on the key itself would move below the projection that makes it, which would then be made twice.
    return items.groupBy(key).agg(F.count(key).alias("members"), F.min(id_column).alias("first")).where("members > 1")


def token_sets(items: DataFrame, id_column: str, least_tokens: int = 5) -> tuple[DataFrame, DataFrame]:
    """(rows, sets): (id, k1, k2, n, hashes) of each item with `least_tokens` or more, and (k1, k2, set_id, n, copies) of each distinct token set.

    `tokens` holds distinct words; they are compared by 64-bit hashes. A set is
    named by its smallest item.
    """
    hashed = items.select(F.col(id_column).alias("id"), token_hashes(F.col("tokens")).alias("hashes"))
    # Read several times below: the texts are normalized once, and for that also before the condition on their tokens.
    rows = cut(keyed(hashed)).where(F.col("n") >= least_tokens)
    return rows, distinct_sets(rows)


def token_hashes(tokens: Column) -> Column:
    return F.array_sort(F.transform(tokens, lambda w: F.xxhash64(w)))


def keyed(hashed: DataFrame) -> DataFrame:
    """`hashed` (id, hashes) with the two keys of the set and its size."""
    return hashed.withColumn("k1", F.xxhash64("hashes")).withColumn("k2", F.xxhash64(F.lit(1), "hashes")).withColumn("n", F.size("hashes"))


def distinct_sets(rows: DataFrame) -> DataFrame:
    """(k1, k2, set_id, n, copies) of each distinct token set of `rows`."""
    return rows.groupBy("k1", "k2").agg(F.min("id").alias("set_id"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"))


def set_members(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, set_id) of each item that has a set."""
    return rows.select("id", "k1", "k2").join(sets.select("k1", "k2", "set_id"), ["k1", "k2"]).select("id", "set_id")


def size_classes(threshold: int, largest: int) -> list[int]:
    """The least sizes of classes of set sizes: a set that is alike enough to one of a class is in the same class or the next to it."""
    least = [1]
    while least[-1] <= largest:
        least.append(100 * least[-1] // threshold + 1)
    return least


def signatures(threshold: int):
    """A function of batches of (k1, n, hashes): rows (k1, n, home, place, part) that two sets which reach the threshold share at least once.

    Sets of sizes nx and ny that reach it differ in at most (nx + ny) (100 - threshold) / (100 + threshold)
    tokens. Tokens are dealt to one place more than that by their hashes, so all tokens of some place are
    equal. How many places there are depends on the class of the larger set; so each set is dealt for its own
    class (`home`) and for the next one. `place` numbers the places of all classes, `part` adds up a place's tokens.
    """

    def once(batch):
        """A batch without the copies in it."""
        _, first = np.unique(batch.column("k1").to_numpy(zero_copy_only=False), return_index=True)
        return batch.take(pa.array(np.sort(first)))

    def deal(batches):
        for batch in (some.slice(k, 500) for some in map(once, batches) for k in range(0, some.num_rows, 500)):
            n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            ids, hashes = batch.column("k1").to_numpy(zero_copy_only=False), batch.column("hashes").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            least = np.array(size_classes(threshold, int(n.max()) * 100 // threshold + 1), dtype=np.int64)
            # The largest size of each class, its number of places, and the places before it.
            places = 2 * (least[1:] - 1) * (100 - threshold) // (100 + threshold) + 1
            before = np.concatenate([[0], np.cumsum(places)])
            own = np.searchsorted(least, n, side="right") - 1
            # Another mixture than the order of the hashes, so that places are dealt evenly.
            mixed = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
            for home in (True, False):
                kind = own if home else own + 1
                rows = np.ones(len(n), bool) if home else n * 100 // threshold >= least[kind]
                mine, count = mixed[np.repeat(rows, n)], places[kind[rows]]
                first = np.concatenate([[0], np.cumsum(count)])
                at = np.repeat(first[:-1], n[rows]) + ((mine >> np.uint64(33)) % np.repeat(count, n[rows]).astype(np.uint64)).astype(np.int64)
                order = np.argsort(at, kind="stable")
                found, start = np.unique(at[order], return_index=True)
                parts = np.zeros(first[-1], np.uint64)
                if len(found):
                    parts[found] = np.add.reduceat(mine[order], start)
                place = np.arange(first[-1]) - np.repeat(first[:-1], count) + np.repeat(before[kind[rows]], count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[rows], count)), pa.array(np.repeat(n[rows], count).astype(np.int32)), pa.array(np.full(first[-1], home)), pa.array(place), pa.array(parts.view(np.int64))],
                    ["k1", "n", "home", "place", "part"],
                )

    return deal


def similar_sets(rows: DataFrame, sets: DataFrame, threshold: int = 90) -> DataFrame:
    """(x, y, shared, total) of the distinct token sets x < y of `token_sets` with 100 * shared / total >= threshold.

    Candidates are the sets that agree in all tokens of a place (see `signatures`):
    some eight tokens at 90, so a frequent word alone makes none, and their number
    grows with the links rather than with the square of a word's sets. Hashes travel
    only to be compared.
    """
    dealt = rows.select("k1", "n", "hashes").mapInArrow(signatures(threshold), "k1 long, n int, home boolean, place long, part long")
    # By signature first, so copies and the join meet where the rows are.
    signed = dealt.select(F.xxhash64("place", "part").alias("s"), "k1", "n", "home").repartition("s").distinct()
    x = signed.select("s", F.col("k1").alias("kx"), F.col("n").alias("nx"), F.col("home").alias("hx"))
    y = signed.select("s", F.col("k1").alias("ky"), F.col("n").alias("ny"), F.col("home").alias("hy"))
    # Of a pair in two classes the larger set is at home, of one in one class both are.
    meets = F.when(F.col("hx") & F.col("hy"), True).when(F.col("hx"), F.col("nx") > F.col("ny")).otherwise(F.col("hy") & (F.col("ny") > F.col("nx")))
    sized = (100 * F.col("nx") >= threshold * F.col("ny")) & (100 * F.col("ny") >= threshold * F.col("nx"))
    pairs = x.join(y, "s").where((F.col("kx") < F.col("ky")) & sized & meets).select("kx", "ky").distinct()
    named = lambda key, name: sets.select(F.col("k1").alias(key), F.col("set_id").alias(name))
    near = cut(pairs.join(named("kx", "a"), "kx").join(named("ky", "b"), "ky").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")))
    counted = shared_tokens(near, rows)
    return counted.where(100 * F.col("shared") >= threshold * (F.col("sum") - F.col("shared"))).select("x", "y", "shared", (F.col("sum") - F.col("shared")).alias("total"))


def shared_tokens(pairs: DataFrame, rows: DataFrame, block_tokens: int = 1 << 20, block_sets: int = 1000, broadcast_ids: int = 1_000_000) -> DataFrame:
    """(x, y, shared, sum) of `pairs` (x, y) of sets, x < y: how many tokens they share, and how many they have together.

    A pair meets under the smallest set that its x is paired with, so in a group
    of like sets each set travels once, not once for each pair. A group above
    `block_tokens` or `block_sets` is cut into blocks, and each block meets the
    others apart; several groups are counted in one task.
    """
    both = pairs.union(pairs.select("y", "x"))
    least = both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("home"))
    homed = cut(pairs.join(least, "x").select("x", "y", "home"))
    ends = F.explode(F.array("x", "y")).alias("id")
    asked = cut(homed.select(ends).distinct())
    # Of the sets without a pair nothing travels; ids are of 8 bytes each.
    rows = rows.join(F.broadcast(asked) if asked.count() <= broadcast_ids else asked, "id", "left_semi")
    members = homed.select("home", ends).distinct().join(rows.select("id", "n"), "id").dropDuplicates(["home", "id"])
    of_home = members.groupBy("home").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("sets"))
    blocks = cut(of_home.select("home", "tokens", F.greatest(F.ceil(F.col("tokens") / block_tokens), F.ceil(F.col("sets") / block_sets)).alias("blocks")))
    size = blocks.agg(F.sum(F.col("tokens") * F.col("blocks"))).first()[0] or 0
    together = max(1, -(-int(size) // (2 * block_tokens)))
    block = lambda c: F.pmod(F.xxhash64(c), F.col("blocks"))
    keyed = homed.join(blocks, "home").select(F.pmod(F.xxhash64("home", block("x"), block("y")), F.lit(together)).cast("int").alias("group"), "x", "y")
    # Of rows with one id one is taken: they have one set.
    held = keyed.select("group", ends).distinct().join(rows.select("id", "hashes"), "id").select(F.col("group").alias("of"), "id", "hashes")

    def count(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        ids, at = np.unique(sets["id"].to_numpy(), return_index=True)
        hashes = sets["hashes"].combine_chunks()
        offsets = hashes.offsets.to_numpy()
        first, n = offsets[at].astype(np.int64), (offsets[at + 1] - offsets[at]).astype(np.int64)
        _, code = np.unique(hashes.values.to_numpy(), return_inverse=True)
        x, y = (np.searchsorted(ids, pairs[c].to_numpy()) for c in ("x", "y"))
        order = np.argsort(x, kind="stable")
        bounds = np.append(np.flatnonzero(np.diff(x[order], prepend=-1)), len(order))
        own, shared = np.zeros(len(code), bool), np.zeros(len(x), np.int64)
        for a, b in zip(bounds, bounds[1:]):
            mine = code[first[x[order[a]]] : first[x[order[a]]] + n[x[order[a]]]]
            own[mine] = True
            for some in (order[k : min(b, k + 256)] for k in range(a, b, 256)):
                long = n[y[some]]
                start = np.cumsum(long) - long
                shared[some] = np.add.reduceat(own[code[np.repeat(first[y[some]] - start, long) + np.arange(long.sum())]].astype(np.int64), start)
            own[mine] = False
        return pa.table([pairs["x"], pairs["y"], pa.array(shared), pa.array(n[x] + n[y])], names=["x", "y", "shared", "sum"])

    return keyed.groupBy("group").cogroup(held.groupBy("of")).applyInArrow(count, "x long, y long, shared long, sum long")


def similar_pairs(items: DataFrame, id_column: str, threshold: int = 90, least_tokens: int = 5) -> DataFrame:
    """(a, b, shared, total, copies_a, copies_b) of similar token sets, each named by its smallest item.

    Items with equal sets are one: their number is in `copies`, so groups of
    copies don't multiply the pairs. A set with copies is also paired with itself.
    """
    rows, sets = token_sets(items, id_column, least_tokens)
    sets = cut(sets)
    itself = sets.where("copies > 1").select(F.col("set_id").alias("x"), F.col("set_id").alias("y"), F.col("n").alias("shared"), F.col("n").alias("total"))
    pairs = similar_sets(rows, sets, threshold).union(itself)
    named = lambda side: sets.select(F.col("set_id").alias(side), F.col("copies").alias(f"copies_{side}"))
    return pairs.withColumnsRenamed({"x": "a", "y": "b"}).join(named("a"), "a").join(named("b"), "b").select("a", "b", "shared", "total", "copies_a", "copies_b")


def representative(items: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """The first row of each group in `order`; each task sends on its own first row of a group alone."""
    return items.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("_n = 1").drop("_n")


def band_pairs(items: DataFrame, id_column: str, key: str, time: str, days: int) -> DataFrame:
    """(a, b) of items a < b with one key and times at most `days` apart, both ends included.

    The key joins with the time cut into bands of the window's width, so a very
    common key meets only its neighbours in time.
    """
    band = F.floor(F.unix_timestamp(time) / F.lit(days * 86400))
    left = items.select(F.col(id_column).alias("a"), F.col(key).alias("_k"), F.col(time).alias("ta"), F.explode(F.array(band - 1, band, band + 1)).alias("_b"))
    right = items.select(F.col(id_column).alias("b"), F.col(key).alias("_k"), F.col(time).alias("tb"), band.alias("_b"))
    gap = F.abs(F.unix_timestamp("ta") - F.unix_timestamp("tb"))
    return left.join(right, ["_k", "_b"]).where((F.col("a") < F.col("b")) & (gap <= days * 86400)).select("a", "b")
