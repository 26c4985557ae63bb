"""Which items, leads and messages are next, and how many there are, as functions of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = ("pending", "processed", "rejected", "failed")
ACTIVE = ("new", "notified", "interested")


def next_in_line(items: DataFrame, status: str, limit: int) -> DataFrame:
    """Up to `limit` items of a status, the first collected first, ties by id."""
    return items.where(F.col("status") == status).orderBy("collected_at", "item_id").limit(limit)


def reset_failed(items: DataFrame, item_id: int | None = None, limit: int | None = None, most: int = 1000) -> DataFrame:
    """`items` in which failed ones are pending again: the one named, or the first `limit`; ValueError unless one of both is given."""
    if (item_id is None) == (limit is None) or (limit is not None and not 1 <= limit <= most):
        raise ValueError("either an item or a limit")
    failed = items.where("status = 'failed'")
    chosen = (failed.where(F.col("item_id") == item_id) if limit is None else next_in_line(items, "failed", limit)).select("item_id").withColumn("_again", F.lit(True))
    joined = items.join(chosen, "item_id", "left")
    return joined.select(*(F.when(F.col("_again"), "pending").otherwise(F.col(c)).alias(c) if c == "status" else c for c in items.columns))


def counts_by(items: DataFrame, column: str, names: tuple[str, ...]) -> DataFrame:
    """(column, items): how many there are of each of `names`, also of those that don't occur."""
    counted = items.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    every = items.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, names))).alias(column))
    return every.join(counted, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("items"))


def bands(score: Column, thresholds: dict[str, int]) -> dict[str, Column]:
    """The condition of each band: from its threshold up to the next higher one."""
    ordered = sorted(thresholds.items(), key=lambda t: -t[1])
    out, above = {}, None
    for name, least in ordered:
        out[name] = (score >= least) if above is None else (score >= least) & (score < above)
        above = least
    return out


def within(time: Column, start: Column, end: Column) -> Column:
    """Half open: the start belongs to the range, the end doesn't."""
    return (time >= start) & (time < end)


def band_counts(items: DataFrame, group: list[Column], thresholds: dict[str, int], **more: Column) -> DataFrame:
    """How many items of each group fall into each band, and meet each further condition."""
    conditions = bands(F.col("score"), thresholds) | more
    return items.groupBy(*group).agg(*(F.count_if(c).alias(name) for name, c in conditions.items()))


def immediate(leads: DataFrame, reserved: DataFrame, marked: DataFrame, threshold: int = 90, limit: int = 100) -> DataFrame:
    """The best leads that are active, reach the threshold, and have neither an envelope (`reserved`: lead_id) nor a marker (`marked`: lead_id)."""
    usable = leads.where((F.col("score") >= threshold) & F.col("status").isin(*ACTIVE))
    new = usable.join(reserved.select("lead_id"), "lead_id", "left_anti").join(marked.select("lead_id"), "lead_id", "left_anti")
    return new.orderBy(F.desc("score"), F.desc("last_seen_at"), "lead_id").limit(limit)


def reserve_immediate(leads: DataFrame, envelopes: DataFrame, marked: DataFrame, paused: bool = False, threshold: int = 90, limit: int = 100) -> DataFrame:
    """(lead_id, envelope_id, rank): a recipient's unfinished envelopes first, the oldest first, then new ones (null id) for the best leads; none in a pause.

    `envelopes`: envelope_id, lead_id, status, created_at, all of that recipient.
    """
    spark, none = leads.sparkSession, F.lit(None).cast("long")
    if paused:
        return spark.range(0).select(F.col("id").alias("lead_id"), none.alias("envelope_id"), F.col("id").cast("int").alias("rank"))
    old = envelopes.where("status IN ('pending', 'sending', 'failed')").select("lead_id", "envelope_id", F.lit(0).alias("part"), F.struct(F.lit(0).alias("score"), F.unix_micros("created_at").alias("at"), F.col("envelope_id").alias("id")).alias("place"))
    new = immediate(leads, envelopes, marked, threshold, limit).select("lead_id", none.alias("envelope_id"), F.lit(1).alias("part"), F.struct((-F.col("score")).cast("int").alias("score"), (-F.unix_micros("last_seen_at")).alias("at"), F.col("lead_id").alias("id")).alias("place"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part", "place", "lead_id", "envelope_id"))), lambda r: F.struct(r["lead_id"].alias("lead_id"), r["envelope_id"].alias("envelope_id")))
    # One recipient's unfinished envelopes and at most `limit` new ones.
    return old.union(new).agg(ordered.alias("all")).select(F.posexplode("all").alias("at", "r")).select("r.*", (F.col("at") + 1).alias("rank"))


def digest_candidates(leads: DataFrame, sent: DataFrame, threshold: int = 55) -> DataFrame:
    """The active leads that reach the threshold and were in no digest before (`sent`: lead_id)."""
    usable = leads.where((F.col("score") >= threshold) & F.col("status").isin(*ACTIVE))
    return usable.join(sent.select("lead_id"), "lead_id", "left_anti")


def next_chunks(chunks: DataFrame) -> DataFrame:
    """(envelope_id, chunks, remaining, next): the first chunk of each envelope that isn't sent, null if all are."""
    open_ = F.col("status") != "sent"
    return chunks.groupBy("envelope_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(open_).alias("remaining"), F.min(F.when(open_, F.col("position"))).alias("next"))


def outcome_tallies(chunks: DataFrame, worst_first: tuple[str, ...]) -> DataFrame:
    """(outcome, envelopes): envelopes by the worst outcome of their chunks."""
    place = F.array_position(F.array(*map(F.lit, worst_first)), F.col("outcome"))
    worst = chunks.groupBy("envelope_id").agg(F.min(place).alias("place"))
    return worst.groupBy("place").agg(F.count(F.lit(1)).alias("envelopes")).select(F.get(F.array(*map(F.lit, worst_first)), (F.col("place") - 1).cast("int")).alias("outcome"), "envelopes")


def status_view(items: DataFrame, envelopes: DataFrame, sources: DataFrame, runs: DataFrame, pauses: DataFrame, recipient: str, most: int = 20) -> DataFrame:
    """One row of what a recipient may ask for: paused, counts of items and own envelopes, and the last run of the first `most` sources by key."""
    from rillflow.operators.collection import last_runs

    work = items.agg(F.count_if(F.col("status") == "pending").alias("items_pending"), F.count_if(F.col("status") == "failed").alias("items_failed"))
    own = envelopes.where(F.col("recipient") == recipient)
    mail = own.agg(F.count_if(F.col("status").isin("pending", "sending")).alias("envelopes_pending"), F.count_if(F.col("status") == "failed").alias("envelopes_failed"))
    shown = last_runs(sources.orderBy("source_key").limit(most), runs)
    collectors = shown.agg(F.array_sort(F.collect_list(F.struct("source_key", "state"))).alias("collectors"))
    paused = pauses.where(F.col("recipient") == recipient).agg(F.coalesce(F.max("paused"), F.lit(False)).alias("paused"))
    return paused.join(work).join(mail).join(collectors)  # single rows


def set_paused(pauses: DataFrame, changes: DataFrame) -> DataFrame:
    """(recipient, paused) after `changes` (recipient, paused, at), the last of each recipient."""
    last = changes.groupBy("recipient").agg(F.max_by("paused", "at").alias("paused"))
    from rillflow.operators.collection import upsert

    return upsert(pauses.select("recipient", "paused"), last, "recipient").drop("action")


def owner_may(actor: Column, chat: Column, allowed: tuple[int, ...]) -> Column:
    """Whether a person may give orders: known, and in the chat with themself."""
    return F.coalesce(actor.isin(*allowed) & (actor == chat), F.lit(False))


def sound_keys(fingerprint: Column, lead: Column) -> Column:
    """A fingerprint is null or 64 lower-case hex digits, a lead's id a UUID in lower case."""
    return F.coalesce(fingerprint.rlike("^[0-9a-f]{64}$"), F.lit(True)) & F.coalesce(lead.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.lit(False))


def query_texts(items: DataFrame, queries: dict[str, str]) -> DataFrame:
    """`items` with the text of the query that found them, by query_id; null for one that isn't listed."""
    known = F.create_map(*[F.lit(x) for pair in queries.items() for x in pair]) if queries else F.create_map().cast("map<string,string>")
    return items.withColumn("query_text", F.get(F.array(F.try_element_at(known, F.col("query_id"))), F.lit(0)))
