"""Clusters kept over batches: a batch reads what it may touch, not all history.

A store is a folder of Parquet tables, each in folders of (batch, place):

- `postings` by band of time: (key, item_id), the keys under which later items ask
  for an item: its text, and of its token set the words that come first by length
  and hash. Two sets that are alike enough share such a word, in any fixed order;
- `members` by band of time: the items with the cluster they are in, or waiting;
- `urls` by hash: which items hold a URL, as URLs link over any time;
- `clusters` by hash: when a cluster was made, and the item that speaks for it.

A batch looks up its keys in its own bands and their neighbours, pulls those
items, the faces of their clusters and the rejected ones of its URLs, replays its
items on top of them, and writes what has changed under its own number. The
number counts only once all is written, so a batch that broke off is repeated.
Of a row that was written repeatedly the last batch's counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.operators import replay as P
from rillflow.operators.lineage import cut

#: What a replay needs of an item.
ITEM = (
    "item_id long, at timestamp, published timestamp, url string, kind string, fingerprint string, tokens array<string>, contacts array<string>, eligible boolean, readable string, score int,"
    " completeness int, grade int, goals array<string>, format string, location string, budget string"
)
COLUMNS = [c.split()[0] for c in ITEM.split(", ")]
TABLES = {
    "postings": ("key long, item_id long", "band"),
    "members": (f"{ITEM}, cluster_id long, method string, similarity double, created timestamp", "band"),
    "urls": ("url string, item_id long, item_band long, cluster_id long, created timestamp", "bucket"),
    "clusters": (f"cluster_id long, created timestamp, face struct<{', '.join(c.replace(' ', ': ', 1) for c in ITEM.split(', '))}>", "bucket"),
}


class ClusterStore:
    """The clusters of all batches so far under `path`, which all executors reach.

    Batches come in the order of their items: none holds an item that arrived
    before one of an earlier batch. `buckets` are the places by which URLs and
    clusters are looked up.
    """

    def __init__(self, spark: SparkSession, path: str, window_days: int = 30, threshold: int = 90, buckets: int = 64, slice_rows: int = 100_000):
        self.spark, self.path = spark, path.rstrip("/")
        self.window, self.threshold, self.buckets, self.slice_rows = window_days, threshold, buckets, slice_rows
        self._scans: dict[str, DataFrame] = {}

    def _files(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def done(self) -> int:
        """The number of the last batch that is complete; 0 before the first."""
        target, system = self._files(f"{self.path}/done")
        return max((int(f.getPath().getName()) for f in system.listStatus(target)), default=0) if system.exists(target) else 0

    def _table(self, name: str, places: list[int] | None = None) -> DataFrame:
        """The rows of a table, of all batches that are complete; of `places` alone if they are given."""
        schema, place = TABLES[name]
        target, system = self._files(f"{self.path}/{name}")
        full = f"{schema}, batch int, {place} long"
        if not self.done() or not system.exists(target):
            return self.spark.createDataFrame([], full)
        rows = self.spark.read.schema(full).parquet(f"{self.path}/{name}").where(F.col("batch") <= self.done())
        if places is not None:
            rows = rows.where(F.col(place).isin(places))
            self._scans[name] = rows
        return rows

    def rows_read(self) -> dict[str, int]:
        """How many rows of each table the last batch has scanned: those of its own places."""
        return {name: rows.count() for name, rows in self._scans.items()}

    @staticmethod
    def _latest(rows: DataFrame, key: str) -> DataFrame:
        """The row of the last batch for each key."""
        return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), "batch").alias("_row")).select("_row.*")

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("long")

    def _keys(self, items: DataFrame) -> DataFrame:
        """(item_id, band, key): under what an item is found and asks for others."""
        n = F.size("tokens")
        first = n - F.floor((n * self.threshold + 99) / 100) + 1
        ranked = F.transform(F.array_sort(F.transform("tokens", lambda w: F.struct((-F.length(w)).alias("n"), F.xxhash64(w).alias("h")))), lambda r: r["h"])
        words = F.when(n >= 5, F.transform(F.slice(ranked, F.lit(1), F.greatest(first, F.lit(1)).cast("int")), lambda h: F.xxhash64(F.lit("word"), h)))
        text = F.when(F.col("fingerprint") != "", F.xxhash64(F.lit("text"), "fingerprint"))
        keys = F.concat(F.filter(F.array(text), lambda k: k.isNotNull()), F.coalesce(words, F.array().cast("array<long>")))
        return items.select("item_id", P.band_of(self.window).alias("band"), F.explode(F.array_distinct(keys)).alias("key"))

    def _places(self, column: DataFrame) -> list[int]:
        """The distinct values of one column of bands (a few for each year) or buckets (a fixed number)."""
        return sorted(r[0] for r in column.distinct().collect() if r[0] is not None)

    def _touched(self, items: DataFrame) -> DataFrame:
        """The earlier items and faces that a batch may meet, with the state in which they are."""
        keys = cut(self._keys(items))
        asked = keys.select("key", F.explode(F.array(*(F.col("band") + k for k in (-1, 0, 1)))).alias("band")).distinct()
        hits = self._table("postings", self._places(asked.select("band"))).join(asked, ["key", "band"]).select("item_id", "band")
        named = items.where("url <> ''").select("url").distinct()
        held = self._latest(self._table("urls", self._places(named.select(self._bucket("url")))).join(named, "url"), "item_id")
        # Of the members that hold a URL the one of the earliest cluster, and all that wait.
        first = F.row_number().over(Window.partitionBy("url", F.col("cluster_id").isNull()).orderBy("created", "cluster_id", "item_id"))
        heads = held.withColumn("place", first).where("cluster_id IS NULL OR place = 1").select("item_id", F.col("item_band").alias("band"))
        ids = cut(hits.union(heads).distinct())
        # Rows of a band are of all batches; an item's last one counts.
        own = self._table("members", self._places(ids.select("band"))).join(ids, ["item_id", "band"], "left_semi")
        members = cut(self._latest(own.select(*COLUMNS, "cluster_id", "created", "batch"), "item_id"))
        touched = members.where("cluster_id IS NOT NULL").select("cluster_id").distinct()
        clusters = cut(self._latest(self._table("clusters", self._places(touched.select(self._bucket("cluster_id")))).join(touched, "cluster_id"), "cluster_id"))
        faces = clusters.select("face.*", "cluster_id", "created")
        rows = members.select(*COLUMNS, "cluster_id", "created").union(faces.select(*COLUMNS, "cluster_id", "created")).dropDuplicates(["item_id"])
        rows = rows.join(clusters.select("cluster_id", F.col("face.item_id").alias("face_id")), "cluster_id", "left")
        state = {"known_cluster": F.col("cluster_id"), "known_created": F.col("created"), "known_face": F.col("face_id").eqNullSafe(F.col("item_id")) & F.col("cluster_id").isNotNull(), "waiting": F.col("cluster_id").isNull()}
        return cut(rows.withColumns(state).drop("cluster_id", "created", "face_id"))

    def add(self, items: DataFrame) -> DataFrame:
        """Cluster a batch; returns what has changed: (item_id, cluster_id, method, similarity, canonical_id), a row for each new item and each that was brought back.

        Takes what `cluster_items` takes, without what is known of earlier items. An
        item that an earlier batch held isn't clustered again.
        """
        self._scans.clear()
        number = self.done() + 1
        items = P.with_optional(items).select(*(F.col(c.split()[0]).cast(c.split(" ", 1)[1]).alias(c.split()[0]) for c in ITEM.split(", ")))
        items = items.dropDuplicates(["item_id"])
        bands = self._places(cut(items.select(P.band_of(self.window).alias("band"))))
        known = self._table("members", bands).select("item_id")
        items = cut(items.join(known, "item_id", "left_anti"))
        before = self._touched(items)
        rows, pairs = P.prepared(items.unionByName(before, allowMissingColumns=True), self.threshold)
        found = cut(P.replayed(rows, pairs, self.window, self.slice_rows))
        changed = cut(P.findings(rows, found).join(found.where("fresh").select("item_id").distinct(), "item_id", "left_semi"))
        made = found.where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.max_by("canonical_id", "step").alias("item_id"), F.max("created").alias("created"))
        self._write(number, rows.select(*COLUMNS), items, changed, cut(made))
        return changed

    def _write(self, number: int, rows: DataFrame, items: DataFrame, changed: DataFrame, made: DataFrame) -> None:
        state = changed.select("item_id", "cluster_id", "method", "similarity").join(made.select("cluster_id", "created"), "cluster_id", "left")
        members = cut(rows.join(state, "item_id").withColumn("band", P.band_of(self.window)))
        # Of the copies that a cluster gets of a text in a band, later items need the first and the last.
        same = ["cluster_id", "fingerprint", F.array_sort(F.coalesce("contacts", F.array())).alias("c"), F.xxhash64("readable").alias("r"), "band"]
        time = F.struct(P.time_of(), "item_id")
        ends = members.where("cluster_id IS NOT NULL").groupBy(*same).agg(F.min_by("item_id", time).alias("first"), F.max_by("item_id", time).alias("last")).select(F.explode(F.array("first", "last")).alias("item_id"))
        posted = ends.union(members.where("cluster_id IS NULL").select("item_id")).distinct()
        faces = rows.select("item_id", F.struct(*COLUMNS).alias("face"))
        out = {
            "members": members.select(*COLUMNS, "cluster_id", "method", "similarity", "created", "band"),
            "postings": self._keys(members.join(posted, "item_id", "left_semi")).select("key", "item_id", "band"),
            "urls": members.where("url <> ''").select("url", "item_id", F.col("band").alias("item_band"), "cluster_id", "created", self._bucket("url").alias("bucket")),
            "clusters": made.join(faces, "item_id").select("cluster_id", "created", "face", self._bucket("cluster_id").alias("bucket")),
        }
        for name, table in out.items():
            place = TABLES[name][1]
            table.repartition(place).write.partitionBy(place).mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")
        target, system = self._files(f"{self.path}/done/{number}")
        system.create(target).close()

    def clusters(self) -> DataFrame:
        """(item_id, cluster_id, method, similarity, canonical_id) of all items so far; those that are rejected have no cluster."""
        members = self._latest(self._table("members").select("item_id", "cluster_id", "method", "similarity", "batch"), "item_id")
        faces = self._latest(self._table("clusters").select("cluster_id", F.col("face.item_id").alias("canonical_id"), "batch"), "cluster_id").drop("batch")
        return members.drop("batch").join(faces, "cluster_id", "left").select("item_id", "cluster_id", "method", "similarity", "canonical_id")
