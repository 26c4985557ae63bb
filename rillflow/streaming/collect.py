"""A collection run: pages as a stream, items appended once, cursors, run rows and pauses."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.operators import collection as C
from rillflow.sources.pages import NAME, PageSource
from rillflow.sources.records import valid

ITEM = "source_key string, external_id string, url string, published_at timestamp, collected_at timestamp, text string, run_id long"
PAGE = "run_id long, source_key string, page long, seen long, inserted long, failed long, error string, retry_after double, latest timestamp"
STATE = "source_key string, cursor long, high_water_mark timestamp, failures int, last_success_at timestamp, paused_until timestamp"
RUN = "run_id long, source_key string, started_at timestamp, finished_at timestamp, status string, items_seen long, items_inserted long, items_failed long, error_category string"
BUCKETS = 64
#: How an item that lacks its source, id or time is named among the errors of a run.
INVALID = "invalid_record"


class Collection:
    """What all runs have collected, under a folder that all executors reach.

    `items` in folders of (bucket of the source, run, batch), `pages` (run, batch),
    `states` and `runs` (run). A run counts as finished once its states are
    written. One that broke off leaves the items of its complete batches, which are
    not appended again; the next run goes on from the last finished one's cursors
    and reports it as interrupted.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        spark.dataSource.register(PageSource)

    def _numbers(self, folder: str) -> list[int]:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        system = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(int(f.getPath().getName().split("=")[1].split("-")[0]) for f in system.listStatus(target) if "=" in f.getPath().getName()) if system.exists(target) else []

    def _read(self, folder: str, schema: str) -> DataFrame:
        if not self._numbers(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.option("recursiveFileLookup", "true").schema(schema).parquet(f"{self.path}/{folder}")

    def items(self, buckets: list[int] | None = None) -> DataFrame:
        """All items; of some buckets of sources, if these are given."""
        there = self._numbers("items")
        wanted = [b for b in there if buckets is None or b in buckets]
        if not wanted:
            return self.spark.createDataFrame([], ITEM)
        return self.spark.read.option("recursiveFileLookup", "true").schema(ITEM).parquet(*[f"{self.path}/items/bucket={b}" for b in wanted])

    def runs(self) -> DataFrame:
        return self._read("runs", RUN)

    def states(self) -> DataFrame:
        """Each source's state after the last finished run."""
        done = self._numbers("states")
        return self.spark.read.schema(STATE).parquet(f"{self.path}/states/run={done[-1]}") if done else self.spark.createDataFrame([], STATE)

    def run(self, folder: str, sources: DataFrame, now: Column, batch_failure=None) -> DataFrame:
        """Read the provider at `folder` on from each source's cursor; the run's rows.

        `sources` are (source_key, kind) of those that may be read; one that is
        paused at `now` is left out, a wall whose first window was lost is refused.
        Sources are configuration: one row of each comes to the driver, as the
        stream's offsets do.
        """
        number = max([0, *self._numbers("started")]) + 1
        before = self.states()
        earlier = self._read("started", RUN)
        ended = self.runs()
        unfinished = earlier.join(ended.select("run_id", "source_key"), ["run_id", "source_key"], "left_anti")
        open_now = sources.join(before.select("source_key", "paused_until"), "source_key", "left").where(F.col("paused_until").isNull() | (F.col("paused_until") <= now)).select("source_key", "kind")
        begin = C.bootstrap(open_now, before.select("source_key", F.col("cursor").cast("string").alias("cursor"), "high_water_mark"), ended).persist()
        started = begin.select(F.lit(number).cast("long").alias("run_id"), "source_key", now.alias("started_at"), *(F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in RUN.split(", ")[3:]))).withColumn("status", F.lit("running"))
        interrupted = C.reconcile(unfinished, open_now, now).where("status = 'failed'")
        interrupted.repartition(1).write.mode("overwrite").parquet(f"{self.path}/runs/run={number}-interrupted")
        started.repartition(1).write.parquet(f"{self.path}/started/run={number}")
        cursors = {r.source_key: int(r.cursor or 0) for r in begin.where("NOT refused").collect()}
        if cursors:
            self._stream(folder, cursors, number, now, batch_failure)
        rows = self._finish(number, started, begin, before, now)
        begin.unpersist()
        return rows

    def _stream(self, folder: str, cursors: dict[str, int], number: int, now: Column, batch_failure) -> None:
        pages = self.spark.readStream.format(NAME).option("folder", folder).option("begin", json.dumps(cursors)).load()

        def append(batch: DataFrame, epoch: int) -> None:
            batch = batch.persist()
            self._append(batch, number, epoch, now)
            batch.unpersist()
            if batch_failure:
                batch_failure(number, epoch)

        query = pages.writeStream.foreachBatch(append).option("checkpointLocation", f"{self.path}/checkpoints/run={number}").trigger(availableNow=True).start()
        query.awaitTermination()

    def _append(self, batch: DataFrame, number: int, epoch: int, now: Column) -> None:
        headers = batch.where("row = 0")
        stop = headers.where("failure IS NOT NULL").groupBy("source_key").agg(F.min("page").alias("stop"))
        # What a provider says after a failed page is read again once the page is good.
        kept = batch.join(stop, "source_key", "left").where(F.col("stop").isNull() | (F.col("page") <= F.col("stop")))
        records = kept.where("row > 0").select("source_key", "external_id", "url", F.timestamp_seconds("published_s").alias("published_at"), now.alias("collected_at"), "text", F.lit(number).cast("long").alias("run_id"), "page", "row")
        good, bad = valid(records)
        bucket = F.pmod(F.xxhash64("source_key"), F.lit(BUCKETS)).cast("int")
        buckets = [r[0] for r in headers.select(bucket).distinct().collect()]
        own = f"run={number}-{epoch}"
        names = [c.split()[0] for c in ITEM.split(", ")]
        new = C.first_wins(good, ["source_key", "external_id"], [F.asc("page"), F.asc("row")], self.items(buckets)).select(*names, "page", bucket.alias("bucket"))
        new.withColumn("batch", F.lit(f"{number}-{epoch}")).write.partitionBy("bucket", "batch").mode("append").parquet(f"{self.path}/items")
        # Read back: computed anew, it would find itself among the items that are there already.
        added = self.spark.read.schema(f"{ITEM}, page long, bucket int, batch string").parquet(f"{self.path}/items").where((F.col("batch") == f"{number}-{epoch}") & F.col("bucket").isin(buckets))
        count = lambda rows, name: rows.groupBy("source_key", "page").agg(F.count(F.lit(1)).alias(name))
        ledger = kept.where("row = 0").select("source_key", "page", F.col("failure").alias("error"), "retry_after")
        for rows, name in ((records, "seen"), (added, "inserted"), (bad, "failed")):
            ledger = ledger.join(count(rows, name), ["source_key", "page"], "left")
        latest = good.groupBy("source_key", "page").agg(F.max("published_at").alias("latest"))
        ledger = ledger.join(latest, ["source_key", "page"], "left").fillna(0, ["seen", "inserted", "failed"])
        ledger = ledger.withColumn("error", F.coalesce("error", F.when(F.col("failed") > 0, INVALID)))
        ledger.select(*(F.lit(number).cast(t).alias(c) if c == "run_id" else F.col(c).cast(t) for c, t in (x.split() for x in PAGE.split(", ")))).write.mode("overwrite").parquet(f"{self.path}/pages/{own}")

    def _finish(self, number: int, started: DataFrame, begin: DataFrame, before: DataFrame, now: Column) -> DataFrame:
        pages = self._read("pages", PAGE).where(F.col("run_id") == number)
        lost = begin.where("refused").select(F.lit(number).cast("long").alias("run_id"), "source_key", *(F.lit(0).cast("long").alias(c) for c in ("seen", "inserted", "failed")), F.lit("cursor_overflow").alias("error"))
        sums = pages.select("source_key", "seen", "inserted", "failed", "error").unionByName(lost.drop("run_id")).withColumnRenamed("source_key", "run_id")
        rows = C.run_rows(sums, started.select(F.col("source_key").alias("run_id"), "source_key", "started_at"), now)
        rows = rows.withColumn("run_id", F.lit(number).cast("long")).select(*(F.col(c).cast(t) for c, t in (x.split() for x in RUN.split(", "))))
        rows.repartition(1).write.mode("overwrite").parquet(f"{self.path}/runs/run={number}")
        rows = self.spark.read.schema(RUN).parquet(f"{self.path}/runs/run={number}")
        # A cursor is the page after the last before any failure, of the page or of an item in it.
        prefix = C.checkpoints(pages.select(F.col("source_key").alias("run_id"), "page", (F.col("page") + 1).alias("cursor"), F.when(F.col("error").isNotNull(), 1).otherwise(0).alias("failed"))).select(F.col("run_id").alias("source_key"), F.col("cursor").alias("reached"))
        good = pages.join(prefix, "source_key").where(F.col("page") < F.col("reached"))
        known = before.join(begin.select("source_key"), "source_key", "full")
        marks = C.high_water(good.select("source_key", F.col("latest").alias("published_at")), known.select("source_key", "high_water_mark")).select("source_key", "high_water_mark")
        waits = pages.groupBy("source_key").agg(F.max("retry_after").alias("retry_after"))
        counts = known.select("source_key", F.coalesce("failures", F.lit(0)).alias("failures"), "last_success_at", "paused_until")
        states = C.next_state(counts, rows.join(waits, "source_key", "left").select("source_key", "status", "retry_after"), now)
        after = known.select("source_key", "cursor").join(prefix, "source_key", "left").select("source_key", F.coalesce("reached", "cursor").alias("cursor"))
        after = after.join(marks, "source_key", "left").join(states, "source_key", "left")
        after.select(*(F.col(c).cast(t) for c, t in (x.split() for x in STATE.split(", ")))).repartition(1).write.mode("overwrite").parquet(f"{self.path}/states/run={number}")
        return rows
