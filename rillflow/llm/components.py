"""Connected components of a large edge list, by DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.storage import Scratch


def _state(links: DataFrame):
    """The number of links and the sum of their 64-bit hashes: equal for equal sets of links."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 50) -> DataFrame:
    """(node, component) of each node of `edges` (a long, b long); a component is named by its smallest node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each
    node links its neighbours to the smallest one it sees until all links point
    at the smallest node of a component. Each round is a table of `scratch`. Loops
    and repeated edges change nothing; an empty list gives no nodes.
    """
    now = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), narrow=True)
    state = _state(now)
    for _ in range(max_rounds):
        # Large star: the larger neighbours of each node go to the smallest of all its neighbours and itself.
        both = now.select("v", "u").union(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        # Small star: the smaller neighbours of each node, and the node, go to the smallest.
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        now = scratch.write(small.union(least.select("v", F.col("m").alias("u"))).distinct(), narrow=True)
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).union(now.select("u", "u").distinct())
