"""From collected records to leads: normal form, rules, fields, score, clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.functions import rules as R
from rillflow.functions import text as T
from rillflow.functions.rules import RulePack
from rillflow.operators.replay import cluster_items


def utc_only(items: DataFrame, *columns: str) -> DataFrame:
    """`items`, or ValueError if a column has times without a zone."""
    kinds = dict(items.dtypes)
    if bad := [c for c in columns if kinds[c] != "timestamp"]:
        raise ValueError(f"times need a zone: {', '.join(bad)}")
    return items


def effective_time() -> Column:
    """When an item counts as said: at its publication, or else when it was collected."""
    return F.coalesce("published_at", "collected_at")


def process(raw: DataFrame, now: Column, pack: RulePack = R.REQUESTS, weights: dict[str, int] = R.WEIGHTS, review: int = R.THRESHOLDS["review"]) -> DataFrame:
    """`raw` with readable, fingerprint_text, fingerprint, canonical_url, intent, subject, confidence, matched, fields, score, reasons, completeness, eligible and contacts.

    Takes item_id, url, published_at, collected_at, text and metadata (JSON).
    Each step is a projection of its own, so that what several columns need is
    made once. A snippet's URL takes the form for the open web, any other its
    canonical form.
    """
    raw = utc_only(raw, "collected_at", "published_at")
    said = lambda name: F.get_json_object("metadata", f"$.{name}")
    rows = raw.withColumn("readable", T.readable(F.col("text"))).withColumn("fingerprint_text", T.fingerprint_text(F.col("readable"), pack.boilerplate))
    rows = rows.withColumns(
        {
            "fingerprint": T.exact_fingerprint(F.col("fingerprint_text")),
            "canonical_url": F.when(said("evidence_kind") == "search_result_snippet", T.public_url("url")).otherwise(T.canonical_url("url")),
            "matched": R.hits(F.col("readable"), pack),
            "fields": R.extract_fields(F.col("readable"), said("response_available") == "true"),
            "contacts": T.contact_signature(F.col("text"), T.java(T.PHONE)),
        }
    )
    kind, sure = R.intent(F.col("matched"), pack)
    rows = rows.withColumns({"intent": kind, "confidence": sure, "subject": R.subject(F.col("matched"), pack)})
    rows = rows.withColumn("reasons", R.reasons(R.request_features(F.col("intent"), F.col("subject"), F.col("fields"), F.col("published_at"), now), weights))
    rows = rows.withColumns({"score": R.total(F.col("reasons")), "completeness": R.completeness(F.col("fields"))})
    return rows.withColumn("eligible", R.eligible(F.col("intent"), F.col("subject"), F.col("score"), review))


def lead_fields(fields: Column) -> list[Column]:
    """The fields by which items are compared."""
    return [fields["grade"].alias("grade"), fields["goals"].alias("goals"), fields["format"].alias("format"), fields["location_text"].alias("location"), fields["budget_text"].alias("budget")]


def cluster(items: DataFrame, window_days: int = 30, threshold: int = 90) -> DataFrame:
    """Clusters of processed items; see `cluster_items`. Members of earlier leads carry known_cluster and known_face."""
    known = [c for c in ("known_cluster", "known_face") if c in items.columns]
    return cluster_items(
        items.select(
            "item_id", F.col("collected_at").alias("at"), F.col("published_at").alias("published"), F.col("canonical_url").alias("url"), F.concat_ws("|", "intent", "subject").alias("kind"), "fingerprint",
            T.tokens(F.col("fingerprint_text")).alias("tokens"), "readable", "contacts", "eligible", "score", "completeness", *lead_fields(F.col("fields")), *known,
        ),
        window_days,
        threshold,
    )


def known_members(leads: DataFrame, occurrences: DataFrame, items: DataFrame) -> DataFrame:
    """`items` with known_cluster and known_face of those that are members of `leads` (lead_id, canonical_item_id) by `occurrences` (lead_id, item_id)."""
    members = leads.join(occurrences, "lead_id").select("item_id", F.col("lead_id").alias("known_cluster"), (F.col("item_id") == F.col("canonical_item_id")).alias("known_face"))
    return items.join(members, "item_id", "left")


def occurrences(clusters: DataFrame) -> DataFrame:
    """(lead_id, item_id, match_method, similarity): each item of a lead once, similarity with two places."""
    return clusters.where("cluster_id IS NOT NULL").select(F.col("cluster_id").alias("lead_id"), "item_id", F.col("method").alias("match_method"), F.bround("similarity", 2).cast("decimal(5,2)").alias("similarity"))


def leads(clusters: DataFrame, items: DataFrame) -> DataFrame:
    """The leads: what the face of each cluster says, all of it together, with the span in which its items were seen.

    first_published is the earliest known publication, last_seen the latest collection.
    """
    of_item = clusters.where("cluster_id IS NOT NULL").join(items.select("item_id", "published_at", "collected_at"), "item_id")
    seen = of_item.groupBy(F.col("cluster_id").alias("lead_id"), F.col("canonical_id").alias("item_id")).agg(F.min("published_at").alias("first_published_at"), F.max("collected_at").alias("last_seen_at"), F.count(F.lit(1)).alias("occurrences"))
    face = items.select("item_id", "intent", "subject", "score", "reasons", "fields")
    return seen.join(face, "item_id").withColumnRenamed("item_id", "canonical_item_id")


def written_back(items: DataFrame, clusters: DataFrame) -> DataFrame:
    """The items with their processing_status (processed or rejected) and what was derived from them."""
    state = clusters.select("item_id", F.when(F.col("cluster_id").isNull(), "rejected").otherwise("processed").alias("processing_status"), "cluster_id")
    return items.drop("processing_status").join(state, "item_id")


def process_pending(items: DataFrame, now: Column, limit: int = 1000, **options) -> tuple[DataFrame, DataFrame]:
    """(processed, failed) of up to `limit` pending items, the first collected first.

    An item that can't be processed, for want of a text or a time, fails alone.
    """
    if limit < 1:
        raise ValueError("a limit of one at least")
    taken = items.where("processing_status = 'pending'").orderBy("collected_at", "item_id").limit(limit)
    broken = F.col("text").isNull() | F.col("collected_at").isNull()
    failed = taken.where(broken).withColumns({"processing_status": F.lit("failed"), "processing_error": F.when(F.col("text").isNull(), "missing_text").otherwise("missing_time")})
    return process(taken.where(~broken), now, **options), failed


def lead_views(leads: DataFrame, items: DataFrame, sources: DataFrame) -> DataFrame:
    """(lead_id, lead): what a card shows, from the lead, its canonical item and that item's source."""
    f = F.col("fields")
    own = items.select(F.col("item_id").alias("canonical_item_id"), "source_key", F.coalesce(F.nullif("canonical_url", F.lit("")), "url").alias("link"), "text", "metadata", "published_at")
    joined = leads.join(own, "canonical_item_id").join(sources.select("source_key", "display_name"), "source_key")
    view = F.struct(
        "score", "subject", f["grade"].alias("grade"), f["goals"].alias("goals"), f["format"].alias("format"), f["urgency"].alias("urgency"), f["location_text"].alias("location"), f["budget_text"].alias("budget"),
        F.transform("reasons", lambda r: r["rule_id"]).alias("reason_ids"), F.col("display_name").alias("source"), "published_at",
        F.coalesce(F.get_json_object("metadata", "$.evidence_kind") == "search_result_snippet", F.lit(False)).alias("is_snippet"), F.col("text").alias("excerpt"), F.col("link").alias("url"),
    )
    return joined.select("lead_id", view.alias("lead"))
