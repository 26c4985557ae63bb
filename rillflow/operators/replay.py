"""Order-dependent clustering, exactly: state-independent links, components, then a replay of each in order.

An item may only join a cluster that holds an item it is linked to: by an equal
URL at any time, or by an equal fingerprint or similar tokens within the window.
Links don't depend on the state, so components of the link graph can be replayed
apart, each in (arrival, id) order. As texts link within the window alone, a text
that comes back after a longer silence begins a component of its own.

A component is replayed in slices of its order. What later slices may still ask
for is carried on: members and rejected items within reach of their times, one
item for each URL that comes again, and the faces of the clusters of all these.
Of the copies that a cluster holds of a text within a band of time the first and
the last are carried: whether one lies within the window of a later item is decided by them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.functions.text import longest
from rillflow.operators.dedup import distinct_sets, keyed, set_members, similar_sets, token_hashes, token_sets
from rillflow.operators.lineage import cut, forget
from rillflow.operators.ranking import distributed_rank

OUT = "item_id long, cluster_id long, method string, similarity double, canonical_id long"
#: Columns that items may leave out, with their types.
OPTIONAL = {
    "published": "timestamp", "readable": "string", "score": "int", "completeness": "int", "grade": "int", "goals": "array<string>", "format": "string", "location": "string", "budget": "string",
    "known_cluster": "long", "known_face": "boolean", "known_created": "timestamp", "waiting": "boolean",
}
#: New items of the components that are replayed in one group, about.
ROWS_TOGETHER = 5_000
STEP = OUT + ", created timestamp, fresh boolean"


def components(edges: DataFrame, nodes: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) by smallest labels, however long the chains; each round is a checkpoint.

    Alternating large-star and small-star rounds (Kiveris et al., 2014) link each
    node's neighbours to the smallest node it sees until no link changes, which
    takes about the logarithm of a chain's length. Raises if `rounds` aren't enough.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    state = _links(now)
    for _ in range(rounds):
        both = now.select("v", "u").union(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        now = cut(small.union(least.select("v", F.col("m").alias("u"))).distinct())
        before, state = state, _links(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return nodes.select("node").join(now.select(F.col("v").alias("node"), "u"), "node", "left").select("node", F.coalesce("u", "node").alias("component"))


def _links(links: DataFrame):
    """The number of links and the sum of their 64-bit hashes: equal for equal sets of links."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


class Item:
    """A row of a replay."""

    def __init__(self, row):
        some = lambda v: None if v is None or v is pd.NaT or v != v else v
        self.id, self.kind, self.url, self.fingerprint, self.eligible = row.item_id, row.kind, row.url or None, row.fingerprint, bool(row.eligible)
        self.at, published = row.at, some(row.published)
        self.time = row.at if published is None else published
        self.set_id, known = some(row.set_id), some(row.known_cluster)
        self.known = None if known is None else int(known)
        self.is_face, self.waits = bool(some(row.known_face)), bool(some(getattr(row, "waiting", None)))
        self.created = some(getattr(row, "known_created", None))
        self.contacts = frozenset(row.contacts) if row.contacts is not None else frozenset()
        self.anchors = sorted(row.tokens, key=lambda t: (-len(t), t))[:3] if row.tokens is not None else []
        self.readable = None if row.readable is None else row.readable.lower()
        self.rank = (some(row.score) or 0, some(row.completeness) or 0, -row.item_id)
        self.grade, self.format = some(row.grade), row.format
        self.goals = frozenset(row.goals) if row.goals is not None else frozenset()
        self.location, self.budget = (row.location or "").casefold(), row.budget or ""

    def shows(self, anchors: list[str]) -> bool:
        """Whether the readable text holds one of the anchors; an item without such a text isn't asked."""
        return self.readable is None or any(a in self.readable for a in anchors)

    def fields_conflict(self, other: Item) -> bool:
        """Whether the known fields of two items can't be of one request."""
        unlike = lambda a, b: bool(a) and bool(b) and a != b
        grades = self.grade is not None and other.grade is not None and self.grade != other.grade
        return grades or unlike(self.goals, other.goals) or {self.format, other.format} == {"online", "offline"} or unlike(self.location, other.location) or unlike(self.budget, other.budget)

    def contacts_conflict(self, other: Item) -> bool:
        return bool(self.contacts and other.contacts and self.contacts != other.contacts)


class Cluster:
    """A cluster in a replay: when it was made, its place in that order, and the item that speaks for it.

    Clusters of which no time is known come before all others, by their ids.
    """

    def __init__(self, own_id: int, created, face: Item):
        self.id, self.created, self.face = own_id, created, face
        self.place = (0, 0, own_id) if created is None else (1, created.value, own_id)


class Replay:
    """The state of one component: earliest cluster by URL, else by fingerprint, else the most similar one."""

    def __init__(self, similar: dict[int, dict[int, float]], window_days: int):
        self.similar, self.window = similar, window_days * 86400
        self.clusters: dict[int, Cluster] = {}
        self.at_url: dict[str, Cluster] = {}  # the earliest cluster with the URL
        self.with_text: dict[str, dict[int, list[Item]]] = {}  # fingerprint, cluster: its members
        self.with_set: dict[int, list[tuple[Cluster, Item]]] = {}
        self.rejected: dict[int, Item] = {}
        self.waiting: dict[tuple, dict[int, Item]] = {}  # the rejected by URL and by fingerprint
        self.out: dict[int, tuple] = {}
        self.fresh: set[int] = set()

    def near(self, a: Item, b: Item) -> bool:
        return abs((a.time - b.time).total_seconds()) <= self.window

    def fits(self, cluster: Cluster, member: Item, item: Item) -> bool:
        return cluster.face.kind == item.kind and self.near(member, item) and not item.contacts_conflict(member) and not item.fields_conflict(cluster.face)

    def match(self, item: Item):
        if item.url in self.at_url:
            return self.at_url[item.url], "exact_url", 100.0
        if not item.anchors:
            return None
        of_text = self.with_text.get(item.fingerprint, {})
        for cluster in sorted((self.clusters[i] for i in of_text), key=lambda c: c.place):
            if any(self.fits(cluster, m, item) for m in reversed(of_text[cluster.id])):
                return cluster, "exact_text", 100.0
        best = None
        for set_id, similarity in self.similar.get(item.set_id, {}).items():
            for cluster, member in self.with_set.get(set_id, ()):
                rank = (-similarity, cluster.place, member.id)
                if (best is None or rank < best[0]) and member.fingerprint != item.fingerprint and member.shows(item.anchors) and self.fits(cluster, member, item):
                    best = rank, cluster
        return best and (best[1], "fuzzy_text", -best[0][0])

    def join(self, cluster: Cluster, item: Item, method: str, similarity: float) -> None:
        self.out[item.id] = (cluster.id, method, round(similarity, 2))
        self.with_text.setdefault(item.fingerprint, {}).setdefault(cluster.id, []).append(item)
        if item.set_id is not None:
            self.with_set.setdefault(item.set_id, []).append((cluster, item))
        if item.url and (item.url not in self.at_url or cluster.place < self.at_url[item.url].place):
            self.at_url[item.url] = cluster

    def load(self, items: list[Item]) -> None:
        """What there was before: members of clusters, and rejected items that still wait."""
        for item in items:
            if item.waits:
                self.reject(item)
            elif item.is_face or item.known not in self.clusters:
                self.clusters[item.known] = Cluster(item.known, item.created, item)
        for item in items:
            if not item.waits:
                self.join(self.clusters[item.known], item, "exact_id", 100.0)

    def reject(self, item: Item) -> None:
        self.rejected[item.id] = item
        for key in self.keys(item):
            self.waiting.setdefault(key, {})[item.id] = item

    def take(self, item: Item) -> None:
        """Ineligible items join clusters but found none; an eligible one brings back the rejected that it stands for."""
        self.fresh.add(item.id)
        best = self.match(item)
        if best is None and not item.eligible:
            return self.reject(item)
        if best is None:
            best = (self.clusters.setdefault(item.id, Cluster(item.id, item.at, item)), "exact_id", 100.0)
        cluster = best[0]
        self.join(cluster, item, *best[1:])
        if item.eligible:
            # A better item speaks for the cluster: higher score, then more complete, then the smaller id.
            if item.rank > cluster.face.rank:
                cluster.face = item
            self.recover(cluster, item)

    def keys(self, item: Item) -> list[tuple]:
        return [key for key in (("url", item.url), ("text", item.fingerprint)) if key[1]]

    def recover(self, cluster: Cluster, item: Item) -> None:
        found = {i: e for key in self.keys(item) for i, e in self.waiting.get(key, {}).items()}
        for earlier in sorted(found.values(), key=lambda e: e.id):
            same_url = item.url is not None and earlier.url == item.url
            same_text = earlier.fingerprint == item.fingerprint and self.near(earlier, item) and earlier.kind == item.kind
            if same_url or same_text and not item.contacts_conflict(earlier) and not item.fields_conflict(earlier):
                del self.rejected[earlier.id]
                for key in self.keys(earlier):
                    del self.waiting[key][earlier.id]
                self.join(cluster, earlier, "exact_url" if same_url else "exact_text", 100.0)
                self.fresh.add(earlier.id)

    def found(self) -> list[tuple]:
        of = self.clusters
        rows = [(i, *found, of[found[0]].face.id, of[found[0]].created, i in self.fresh) for i, found in self.out.items()]
        return rows + [(i, None, None, None, None, None, i in self.fresh) for i in self.rejected]


def replay(rows: pd.DataFrame, links: pd.DataFrame, window_days: int = 30) -> pd.DataFrame:
    """The clusters of components, or of slices of them with what was carried on: `rows` are their items, `links` (x, y, similarity) their pairs of token sets.

    Both may have the component (`component`, `part`); without, all is one.
    Rows with known_cluster or waiting are what there was before. `fresh` marks
    the new items, and the rejected ones that were brought back.
    """
    similar: dict[int, dict[int, dict[int, float]]] = {}
    for part, x, y, s in zip(links.part if "part" in links else [0] * len(links), links.x, links.y, links.similarity):
        own = similar.setdefault(part, {})
        own.setdefault(x, {})[y] = s
        own.setdefault(y, {})[x] = s
    components: dict[int, list[Item]] = {}
    for component, r in zip(rows.component if "component" in rows else [0] * len(rows), rows.itertuples(index=False)):
        components.setdefault(component, []).append(Item(r))
    before = lambda i: i.known is not None or i.waits
    found = []
    for component, items in components.items():
        alike = similar.get(component, {})
        for item in items:
            if item.set_id is not None:
                alike.setdefault(item.set_id, {})[item.set_id] = 100.0
        state = Replay(alike, window_days)
        state.load(sorted((i for i in items if before(i)), key=lambda i: i.id))
        for item in sorted((i for i in items if not before(i)), key=lambda i: (i.at, i.id)):
            state.take(item)
        found += state.found()
    out = pd.DataFrame(found, columns=["item_id", "cluster_id", "method", "similarity", "canonical_id", "created", "fresh"])
    return out.astype({"cluster_id": "Int64", "canonical_id": "Int64", "created": "datetime64[ns]", "fresh": "bool"})


def with_optional(items: DataFrame) -> DataFrame:
    return items.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in items.columns})


def time_of() -> Column:
    """When an item counts as said, in seconds."""
    return F.coalesce("published", "at").cast("double")


def in_bands(items: DataFrame, key: str, window_days: int) -> DataFrame:
    """(key, band, rep, lo, hi): the items of a key in each band of time of the window's width, their smallest id, first and last time."""
    known = items.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    return known.groupBy(F.col(key).alias("key"), band_of(window_days).alias("band")).agg(F.min("item_id").alias("rep"), F.min(time_of()).alias("lo"), F.max(time_of()).alias("hi"))


def band_of(window_days: int) -> Column:
    return F.floor(time_of() / (window_days * 86400))


def timely(rows: DataFrame, groups: DataFrame, key: str, window_days: int) -> DataFrame:
    """Edges from each item to the first of its key and band, and from there to the next band's, if the window reaches over."""
    own = rows.where(F.col(key).isNotNull()).select("item_id", F.col(key).alias("key"), band_of(window_days).alias("band"))
    stars = own.join(groups, ["key", "band"]).select(F.col("rep").alias("a"), F.col("item_id").alias("b"))
    following = groups.select("key", (F.col("band") - 1).alias("band"), F.col("rep").alias("next"), F.col("lo").alias("from"))
    return stars.union(groups.join(following, ["key", "band"]).where(F.col("from") - F.col("hi") <= window_days * 86400).select("rep", "next"))


def link_edges(items: DataFrame, pairs: DataFrame, window_days: int) -> DataFrame:
    """(a, b) edges whose components hold all items that may meet in one cluster: of a URL, of a cluster that is known, and of like texts within the window."""

    def always(column):
        known = items.where(F.col(column).isNotNull() & (F.col(column).cast("string") != ""))
        return known.join(known.groupBy(column).agg(F.min("item_id").alias("a")), column).select("a", F.col("item_id").alias("b"))

    texts, sets = in_bands(items, "fingerprint", window_days), cut(in_bands(items, "set_id", window_days))
    x = sets.select(F.col("key").alias("x"), F.col("rep").alias("a"), F.col("lo").alias("lx"), F.col("hi").alias("hx"), F.explode(F.array(*(F.col("band") + k for k in (-1, 0, 1)))).alias("band"))
    y = sets.select(F.col("key").alias("y"), F.col("rep").alias("b"), F.col("lo").alias("ly"), F.col("hi").alias("hy"), "band")
    reach = window_days * 86400
    similar = pairs.select("x", "y").join(x, "x").join(y, ["y", "band"]).where((F.col("lx") - F.col("hy") <= reach) & (F.col("ly") - F.col("hx") <= reach)).select("a", "b")
    edges = always("url").union(always("known_cluster")).union(timely(items, texts, "fingerprint", window_days)).union(timely(items, sets, "set_id", window_days)).union(similar)
    return edges.where("a <> b")


def carried(state: DataFrame, later: DataFrame, urls: DataFrame, window_days: int) -> DataFrame:
    """What of `state` the coming slices may ask for; `later` has (component, lo, hi) of their times, `urls` their (component, url)."""
    reach = window_days * 86400
    known = state.join(later, "component").where(F.col("known_cluster").isNotNull() | F.col("waiting"))
    known = cut(known.join(urls.withColumn("comes", F.lit(True)), ["component", "url"], "left").withColumn("open", time_of().between(F.col("lo") - reach, F.col("hi") + reach)).drop("lo", "hi"))
    row = F.struct(*state.columns)
    # The first and the last of a cluster's copies of a text in a band.
    same = ["component", "known_cluster", "fingerprint", "set_id", F.array_sort(F.coalesce("contacts", F.array())).alias("c"), F.xxhash64("readable").alias("r"), band_of(window_days).alias("b")]
    ends = known.where("open AND NOT coalesce(waiting, false)").groupBy(*same).agg(F.min_by(row, F.struct(time_of(), "item_id")).alias("first"), F.max_by(row, F.struct(time_of(), "item_id")).alias("last"))
    members = ends.select(F.explode(F.array("first", "last")).alias("row"))
    heads = known.where("comes AND NOT coalesce(waiting, false)").groupBy("component", "url").agg(F.min_by(row, F.struct("known_created", "known_cluster", "item_id")).alias("row")).select("row")
    waiting = known.where("waiting AND (open OR comes)").select(row.alias("row"))
    kept = cut(members.union(heads).union(waiting).select("row.*").dropDuplicates(["item_id"]))
    faces = known.where("known_face").select(*state.columns).join(kept.select("known_cluster").distinct(), "known_cluster", "left_semi").select(*state.columns)
    return cut(kept.union(faces).dropDuplicates(["item_id"]))


def step(items: DataFrame, links: DataFrame, window_days: int, together: int) -> DataFrame:
    """One replay of each component of `items` (with what was carried on), in `together` groups of components; `links` are (part, x, y, similarity)."""
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(together)).alias("group")
    return items.groupBy(group("component")).cogroup(links.groupBy(group("part"))).applyInPandas(lambda rows, linked: replay(rows, linked, window_days), STEP)


def applied(items: DataFrame, found: DataFrame) -> DataFrame:
    """`items` with the state that a step has found for them."""
    state = found.select("item_id", "cluster_id", F.col("canonical_id").eqNullSafe(F.col("item_id")).alias("face"), "created")
    joined = items.drop("known_cluster", "known_face", "known_created", "waiting").join(state, "item_id")
    return joined.select(
        *[c for c in items.columns if c not in ("known_cluster", "known_face", "known_created", "waiting")],
        F.col("cluster_id").alias("known_cluster"), F.col("face").alias("known_face"), F.col("created").alias("known_created"), F.col("cluster_id").isNull().alias("waiting"),
    )


def replay_slices(items: DataFrame, links: DataFrame, window_days: int, slice_rows: int) -> DataFrame:
    """The findings of all steps, with their number: `items` have a component, `links` are (part, x, y, similarity)."""
    before = F.col("known_cluster").isNotNull() | F.coalesce("waiting", F.lit(False))
    fresh = items.where(~before).select("item_id", "component", "at", F.col("url"), time_of().alias("t"))
    sizes, total = (n or 0 for n in fresh.groupBy("component").count().agg(F.max("count"), F.sum("count")).first())
    # Most components are of a few items, and a group of its own would cost each far more than its replay.
    together = max(1, -(-total // ROWS_TOGETHER))
    steps = max(1, -(-sizes // slice_rows))
    if steps == 1:
        return step(items, links, window_days, together).withColumn("step", F.lit(0))
    ranked = cut(distributed_rank(fresh, "component", [F.col("at"), F.col("item_id")]).withColumn("slice", F.floor((F.col("rank") - 1) / slice_rows)))
    numbered = items.where(~before).join(ranked.select("item_id", "slice"), "item_id")
    own, state, found = items.columns, items.where(before), []
    for number in range(steps):
        now = cut(state.select(*own).union(numbered.where(F.col("slice") == number).select(*own)))
        found.append(cut(step(now, links, window_days, together).withColumn("step", F.lit(number))))
        if number + 1 < steps:
            after = ranked.where(F.col("slice") > number)
            later = after.groupBy("component").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
            state = carried(applied(now, found[-1]), later, after.where("url <> ''").select("component", "url").distinct(), window_days)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def prepared(items: DataFrame, threshold: int, whole: bool = True) -> tuple[DataFrame, DataFrame]:
    """(items with their set_id, pairs (x, y, similarity) of similar token sets); unless `whole`, items keep their three longest tokens, all that a replay asks for."""
    if not whole:
        # The tokens of an item are written once, as hashes; the items as they are replayed, with their anchors.
        kept = cut(with_optional(items).withColumns({"anchors": longest(F.col("tokens")), "hashes": token_hashes(F.col("tokens"))}).drop("tokens"))
        rows = keyed(kept.select(F.col("item_id").alias("id"), "hashes")).where(F.col("n") >= 5)
        items, sets = kept.drop("hashes").withColumnRenamed("anchors", "tokens"), distinct_sets(rows)
    else:
        kept = items = cut(with_optional(items))  # read for each kind of link
        rows, sets = token_sets(items, "item_id")
    sets = cut(sets)
    pairs = cut(similar_sets(rows, sets, threshold).select("x", "y", (100.0 * F.col("shared") / F.col("total")).alias("similarity")))
    items = cut(items.join(set_members(rows, sets).withColumnRenamed("id", "item_id"), "item_id", "left"))
    forget(kept)
    return items, pairs


def replayed(items: DataFrame, pairs: DataFrame, window_days: int, slice_rows: int) -> DataFrame:
    """The findings of all steps for items with set_id and their pairs of sets."""
    label = cut(components(link_edges(items, pairs, window_days), items.select(F.col("item_id").alias("node"))))
    grouped = cut(items.join(label.withColumnRenamed("node", "item_id"), "item_id"))
    own = grouped.where("set_id IS NOT NULL").select(F.col("set_id").alias("x"), F.col("component").alias("part")).distinct()
    return replay_slices(grouped, cut(pairs.join(own, "x").select("part", "x", "y", "similarity")), window_days, slice_rows)


def cluster_items(items: DataFrame, window_days: int = 30, threshold: int = 90, slice_rows: int = 100_000) -> DataFrame:
    """(item_id, cluster_id, method, similarity, canonical_id) of `items`; those that are rejected have no cluster.

    Takes item_id, at (arrival), url, kind (items of one cluster are of one),
    fingerprint, tokens, contacts, eligible; and if they are given: published,
    which counts instead of the arrival for the window; readable, which must hold
    one of a similar item's longest words; score and completeness, which choose
    the face; grade, goals, format, location and budget, which must not conflict;
    known_cluster, known_face and known_created of members of clusters that exist
    already, and waiting of earlier items that were rejected. Components of up to
    `slice_rows` new items take one step, larger ones one for each slice: a task
    holds a slice and what is carried on. Of that, copies of a text within a
    cluster don't add to it; rejected items within reach of later ones do.
    """
    items, pairs = prepared(items, threshold, whole=False)
    found = cut(replayed(items, pairs, window_days, slice_rows))
    return findings(items, found)


def findings(items: DataFrame, found: DataFrame) -> DataFrame:
    """The last word of all steps on each item, with the face that each cluster has at the end."""
    faces = found.where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.max_by("canonical_id", "step").alias("canonical_id"))
    last = found.where("fresh").groupBy("item_id").agg(F.max_by(F.struct("cluster_id", "method", "similarity"), "step").alias("x")).select("item_id", "x.cluster_id", "x.method", "x.similarity")
    kept = items.where("known_cluster IS NOT NULL").select("item_id", F.col("known_cluster").alias("cluster_id"), F.lit("exact_id").alias("method"), F.lit(100.0).alias("similarity"))
    still = items.where("waiting").join(last, "item_id", "left_anti").select("item_id", *(F.lit(None).cast(t).alias(c) for c, t in (("cluster_id", "long"), ("method", "string"), ("similarity", "double"))))
    return last.union(kept).union(still).join(faces, "cluster_id", "left").select("item_id", "cluster_id", "method", "similarity", "canonical_id")
