"""Collecting from sources: registry, idempotent appends, runs, cursors and pauses, as functions of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a finished or broken-off run says.
RUN = "run_id, source_key, started_at, finished_at, status, items_seen, items_inserted, items_failed, error_category"


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of `old` with those of `new` over them, by `key`, and the action: inserted, updated or kept.

    Both have the same columns. Nothing is deleted for want of a new row, and a
    new null leaves no old value behind: a row is replaced as a whole.
    """
    columns = old.columns
    both = old.select(F.col(key), F.lit(0).alias("_new"), F.struct(*columns).alias("_row")).union(new.select(F.col(key), F.lit(1), F.struct(*columns)))
    last = both.groupBy(key).agg(F.max_by("_row", "_new").alias("_row"), F.min("_new").alias("_least"), F.max("_new").alias("_most"))
    action = F.when(F.col("_least") == 1, "inserted").when(F.col("_most") == 0, "kept").otherwise("updated")
    return last.select("_row.*", action.alias("action"))


def first_wins(arrivals: DataFrame, keys: list[str], order: list[Column], existing: DataFrame | None = None) -> DataFrame:
    """One row a key, the first to arrive, without the keys of `existing`; rows without a key are left out."""
    known = arrivals.dropna(subset=keys)
    first = known.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    return first if existing is None else first.join(existing.select(*keys), keys, "left_anti")


def high_water(inserted: DataFrame, marks: DataFrame) -> DataFrame:
    """(source_key, high_water_mark, inserted): the latest known publication so far; a mark never falls."""
    new = inserted.groupBy("source_key").agg(F.max("published_at").alias("latest"), F.count(F.lit(1)).alias("inserted"))
    joined = marks.join(new, "source_key", "full")
    return joined.select("source_key", F.greatest("high_water_mark", "latest").alias("high_water_mark"), F.coalesce("inserted", F.lit(0)).alias("inserted"))


def checkpoints(pages: DataFrame) -> DataFrame:
    """(run_id, pages, cursor, failed): the cursor of the last page before any failure; null if the first page failed.

    `pages`: run_id, page, cursor, failed (items). Later pages are kept, but the
    cursor doesn't pass a failed one, so a replay meets it again. The prefix is
    found by the first failed page of a run, without a sort of the pages.
    """
    first_bad = pages.where("failed > 0").groupBy("run_id").agg(F.min("page").alias("bad"))
    joined = pages.join(first_bad, "run_id", "left")
    good = F.when(F.col("bad").isNull() | (F.col("page") < F.col("bad")), F.struct("page", "cursor"))
    return joined.groupBy("run_id").agg(F.count(F.lit(1)).alias("pages"), F.max(good).getField("cursor").alias("cursor"), F.sum("failed").alias("failed"))


def run_status(error: Column, seen: Column, failed: Column) -> Column:
    """succeeded without an error, partial if some items went well, else failed."""
    return F.when(~error, "succeeded").when(seen > failed, "partial").otherwise("failed")


def run_rows(pages: DataFrame, runs: DataFrame, finished_at: Column) -> DataFrame:
    """The rows of finished runs: `pages` (run_id, seen, inserted, failed, error), `runs` (run_id, source_key, started_at); a run without pages saw nothing."""
    sums = pages.groupBy("run_id").agg(*(F.sum(c).alias(f"items_{c}") for c in ("seen", "inserted", "failed")), F.max("error").alias("error_category"))
    counts = runs.join(sums, "run_id", "left").fillna(0, ["items_seen", "items_inserted", "items_failed"])
    status = run_status(F.col("error_category").isNotNull(), F.col("items_seen"), F.col("items_failed"))
    return counts.select("run_id", "source_key", "started_at", finished_at.alias("finished_at"), status.alias("status"), "items_seen", "items_inserted", "items_failed", "error_category")


def reconcile(runs: DataFrame, starting: DataFrame, now: Column) -> DataFrame:
    """`runs` in which those that still run, of the sources of `starting` (source_key), are failed as interrupted."""
    named = starting.select("source_key").distinct().withColumn("_starts", F.lit(True))
    stale = (F.col("status") == "running") & F.coalesce("_starts", F.lit(False))
    joined = runs.join(named, "source_key", "left")
    changed = {"status": F.when(stale, "failed").otherwise(F.col("status")), "finished_at": F.when(stale, now).otherwise(F.col("finished_at")), "error_category": F.when(stale, "interrupted").otherwise(F.col("error_category"))}
    return joined.select(*(changed.get(c, F.col(c)).alias(c) for c in runs.columns))


def bootstrap(sources: DataFrame, states: DataFrame, runs: DataFrame) -> DataFrame:
    """(source_key, since, cursor, refused) for each source to be read.

    The mark counts only where there is no cursor. A wall that was never read to
    a cursor, though an earlier run of it that didn't succeed saw items, is
    refused: what came in between could be lost.
    """
    seen = runs.where("status IN ('failed', 'partial') AND items_seen > 0").select("source_key").distinct().withColumn("_seen", F.lit(True))
    joined = sources.join(states, "source_key", "left").join(seen, "source_key", "left")
    refused = (F.col("kind") == "wall") & F.col("cursor").isNull() & F.coalesce("_seen", F.lit(False))
    return joined.select("source_key", F.when(F.col("cursor").isNull(), F.col("high_water_mark")).alias("since"), "cursor", refused.alias("refused"))


def next_state(states: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """`states` (source_key, failures, last_success_at, paused_until) after `runs` (source_key, status, retry_after seconds or null), one of each source.

    A success ends the count of failures; a failure that says when to come back pauses its source.
    """
    joined = states.join(runs.select("source_key", "status", "retry_after"), "source_key", "left")
    good, bad = F.col("status") == "succeeded", F.col("status").isNotNull() & (F.col("status") != "succeeded")
    return joined.select(
        "source_key",
        F.when(good, 0).when(bad, F.col("failures") + 1).otherwise(F.col("failures")).alias("failures"),
        F.when(good, now).otherwise(F.col("last_success_at")).alias("last_success_at"),
        F.when(bad & F.col("retry_after").isNotNull(), F.timestamp_seconds(F.unix_timestamp(now) + F.col("retry_after"))).otherwise(F.col("paused_until")).alias("paused_until"),
    )


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in `order`; each task sends on its own first row of a key alone."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def last_runs(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """(source_key, run_id, state): the latest run of each source, or never_run."""
    newest = latest(runs, "source_key", [F.desc("started_at"), F.asc("run_id")])
    return sources.select("source_key").join(newest.select("source_key", "run_id", "status"), "source_key", "left").select("source_key", "run_id", F.coalesce("status", F.lit("never_run")).alias("state"))
