"""Expiry of what is no longer needed, with everything kept that something kept refers to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Periods:
    """Days for which things are kept."""

    rejected: int = 30
    leads: int = 90
    notifications: int = 180


def before(now: Column, days: Column | int) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(now) - (days if isinstance(days, Column) else F.lit(days)) * 86400)


def protected_leads(feedback: DataFrame, notifications: DataFrame, items: DataFrame, expired: DataFrame) -> DataFrame:
    """(lead_id) of the leads with feedback, or with a notification or a place in a digest that isn't expired (notification_id)."""
    kept = notifications.join(expired, "notification_id", "left_anti").select("lead_id")
    listed = items.join(expired, "notification_id", "left_anti").select("lead_id")
    return feedback.select("lead_id").union(kept).union(listed).where("lead_id IS NOT NULL").distinct()


def expired_raw(raw: DataFrame, sources: DataFrame, retained: DataFrame, now: Column, periods: Periods) -> DataFrame:
    """Settled records past their time that no kept lead holds (`retained`: item_id); a source may ask for fewer days than its kind of record has."""
    own = F.when(F.col("status") == "rejected", periods.rejected).otherwise(periods.leads)
    joined = raw.where("status IN ('rejected', 'processed')").join(sources.select("source_key", "retention_days"), "source_key")
    old = joined.where(F.col("collected_at") < before(now, F.least(own, F.coalesce("retention_days", F.lit(periods.leads)))))
    return old.join(retained.select("item_id").distinct(), "item_id", "left_anti").select(*raw.columns)


def plan(tables: dict[str, DataFrame], now: Column, periods: Periods = Periods()) -> dict[str, DataFrame]:
    """What expires of each table: notifications, notification_items, notification_chunks, leads, occurrences, raw, runs.

    `tables` also holds feedback and sources. Notifications of a recipient who
    is being sent to (`busy`, if given: recipient) stay. A lead goes if it is
    old and nothing that stays refers to it; its occurrences go with it, and
    records that no other lead holds.
    """
    t = tables
    old = t["notifications"].where(F.col("created_at") < before(now, periods.notifications))
    if "busy" in t:
        old = old.join(t["busy"].select("recipient"), "recipient", "left_anti")
    expired = old.select("notification_id")
    safe = protected_leads(t["feedback"], t["notifications"], t["notification_items"], expired)
    leads = t["leads"].where(F.col("last_seen_at") < before(now, periods.leads)).join(safe, "lead_id", "left_anti")
    gone = leads.select("lead_id")
    held = t["occurrences"].join(gone, "lead_id", "left_anti").select("item_id").union(t["leads"].join(gone, "lead_id", "left_anti").select(F.col("canonical_item_id")))
    return {
        "notifications": old,
        "notification_items": t["notification_items"].join(expired, "notification_id", "left_semi"),
        "notification_chunks": t["notification_chunks"].join(expired, "notification_id", "left_semi"),
        "leads": leads,
        "occurrences": t["occurrences"].join(gone, "lead_id", "left_semi"),
        "raw": expired_raw(t["raw"], t["sources"], held, now, periods),
        "runs": t["runs"].where((F.col("status") != "running") & (F.col("finished_at") < before(now, periods.notifications))),
    }


def counts(expiring: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of what expires of each table: a dry run."""
    single = [rows.agg(F.count(F.lit(1)).alias(name)) for name, rows in expiring.items()]
    out = single[0]
    for other in single[1:]:
        out = out.join(other)
    return out


def kept(table: DataFrame, expiring: DataFrame, key: list[str]) -> DataFrame:
    """`table` without what expires."""
    return table.join(expiring.select(*key), key, "left_anti")


def hashed(kind: str, value: Column) -> Column:
    """The hash of a value under its kind, so that equal values of two kinds differ."""
    return F.sha2(F.concat(F.lit(f"{kind}:"), value), 256)


def tombstones(expired: DataFrame, items: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(recipient_hash, kind, scope_key) that outlive expired notifications, each once and without any content.

    `expired`: notification_id, recipient, kind, lead_id, period_key. An
    immediate one leaves its lead; a digest leaves its period, and each lead of
    `items` (notification_id, lead_id) that it held.
    """
    who = hashed("recipient", F.col("recipient")).alias("recipient_hash")
    alone = expired.where("kind = 'immediate'").select(who, F.lit("immediate").alias("kind"), F.col("lead_id").cast("string").alias("scope_key"))
    periods = expired.where("kind = 'digest'").select(who, F.lit("digest").alias("kind"), hashed("period", F.col("period_key")).alias("scope_key"))
    listed = expired.where("kind = 'digest'").select("notification_id", "recipient").join(items, "notification_id").select(who, F.lit("digest_item").alias("kind"), F.col("lead_id").cast("string").alias("scope_key"))
    new = alone.union(periods).union(listed).where("scope_key IS NOT NULL").distinct()
    return new if existing is None else new.join(existing, ["recipient_hash", "kind", "scope_key"], "left_anti")
