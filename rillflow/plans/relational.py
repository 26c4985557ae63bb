"""Ingest, selection, delivery, feedback and retention over tables projected from the data; times are seconds."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillflow.functions import outcomes as O
from rillflow.functions import rules as R
from rillflow.operators import collection as C
from rillflow.operators import dedup
from rillflow.operators import retention as E
from rillflow.operators import selection as S
from rillflow.sources.gates import may_read
from rillflow.sources.records import table
from rillflow.streaming.feedback import CHOICES

BANDS = {"immediate": 90, "digest": 55, "review": 45}


def at(seconds):
    return F.timestamp_seconds(seconds)


def items(spark, sf_dir):
    """Records with a processing state, a score and a lead's status."""
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        n.alias("item_id"), F.col("source").alias("source_key"), "n_chars", at(n * 60).alias("collected_at"), F.when(n % 10 != 0, at(n * 60 - n % 40 * 86400)).alias("published_at"),
        F.when(n % 7 == 0, "rejected").when(n % 11 == 0, "failed").when(n % 13 == 0, "pending").otherwise("processed").alias("status"), (n * 37 % 101).alias("score"),
        F.when(n % 5 == 0, "notified").when(n % 5 == 1, "rejected").otherwise("new").alias("lead_status"),
    )


def leads(spark, sf_dir):
    return items(spark, sf_dir).select(F.col("item_id").alias("lead_id"), "score", F.col("lead_status").alias("status"), F.col("collected_at").alias("last_seen_at"), F.coalesce("published_at", "collected_at").alias("said_at"))


def runs(spark, sf_dir):
    """Runs of numbered sources, an event each."""
    n = F.col("event_id")
    seen = 1 + n % 9
    return table(spark, sf_dir, "events").select(n.alias("run_id"), F.col("user_id").alias("source_key"), "event_type", seen.alias("seen"), F.when(F.col("event_type") == "error", seen).otherwise(n % 3).alias("failed"))


def callbacks(spark, sf_dir):
    """Answers about numbered leads: the events that are one."""
    choice = F.create_map(*[F.lit(x) for pair in CHOICES.items() for x in pair])
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin(*CHOICES))
    return rows.select(F.col("event_id").alias("callback_id"), F.col("user_id").alias("actor"), (F.col("event_id") % 97).alias("lead"), F.element_at(choice, F.col("event_type")).alias("choice"))


def seconds(time):
    return F.unix_timestamp(time)


def source_gates(spark, sf_dir):
    counted = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("items"), F.min("doc_id").alias("n"))
    n = F.col("n")
    registry = counted.select("source", "items", (n % 2 == 0).alias("enabled"), F.when(n % 3 != 0, "approved").otherwise("pending").alias("policy_status"), F.when(n % 4 == 0, at(F.lit(5000))).alias("paused_until"), F.lit(None).cast("timestamp").alias("authorized_until"))
    return registry.where(may_read(at(F.lit(1000)))).select("source", "items")


def source_upsert(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    old = docs.where("doc_id % 2 = 0").groupBy("source").agg(F.min("doc_id").alias("config"))
    new = docs.where("doc_id % 3 = 0").groupBy("source").agg(F.max("doc_id").alias("config"))
    return C.upsert(old, new, "source")


def ingest_first_wins(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    once = docs.select(F.col("doc_id").alias("external_id"), "source", "n_chars", F.col("doc_id").alias("arrived"))
    again = docs.where("doc_id % 3 = 0").select("doc_id", "source", F.col("n_chars") + 1, F.col("doc_id") + 1000000000)
    return C.first_wins(once.union(again), ["source", "external_id"], [F.asc("arrived")]).drop("arrived")


def ingest_high_water(spark, sf_dir):
    rows = items(spark, sf_dir)
    none = rows.select("source_key", F.lit(None).cast("timestamp").alias("high_water_mark")).distinct()
    marks = C.high_water(rows, none)
    return marks.select(F.col("source_key").alias("source"), "inserted", F.coalesce(seconds("high_water_mark"), F.lit(-1)).alias("high_water_s"))


def checkpoint_prefix(spark, sf_dir):
    pages = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("page"), F.col("event_id").alias("cursor"), (F.col("event_type") == "error").cast("long").alias("failed"))
    return C.checkpoints(pages).select(F.col("run_id").alias("user_id"), "pages", F.coalesce("cursor", F.lit(-1)).alias("cursor_at"), "failed")


def run_status(spark, sf_dir):
    return runs(spark, sf_dir).select("run_id", C.run_status(F.col("failed") > 0, F.col("seen"), F.col("failed")).alias("status"))


def run_totals(spark, sf_dir):
    return runs(spark, sf_dir).groupBy(F.col("source_key").alias("user_id")).agg(F.sum("seen").alias("seen"), F.sum("failed").alias("failed"), F.max("run_id").alias("last_run"))


def latest_run_per_source(spark, sf_dir):
    sources = table(spark, sf_dir, "documents").select("source").distinct().select("source", F.substring("source", 4, 100).cast("long").alias("source_key"))
    known = runs(spark, sf_dir).select("source_key", "run_id", at("run_id").alias("started_at"), F.col("event_type").alias("status"))
    last = C.last_runs(sources, known)
    return sources.join(last, "source_key", "left").select("source", F.coalesce("run_id", F.lit(-1)).alias("run_id"), F.coalesce("state", F.lit("never_run")).alias("state"))


def claim_order_topk(spark, sf_dir):
    return S.next_in_line(items(spark, sf_dir), "pending", 100).select("item_id", seconds("collected_at").alias("collected_s"))


def failed_list(spark, sf_dir):
    return S.next_in_line(items(spark, sf_dir), "failed", 50).select("item_id", seconds("collected_at").alias("collected_s"))


def failed_reset(spark, sf_dir):
    return S.reset_failed(items(spark, sf_dir), limit=1000).select("item_id", "status")


def status_counts(spark, sf_dir):
    return S.counts_by(items(spark, sf_dir), "status", S.STATES)


def score_bands(spark, sf_dir):
    return S.band_counts(items(spark, sf_dir), [F.col("source_key").alias("source")], BANDS)


def eligible_items(spark, sf_dir):
    n = F.col("item_id")
    kind = F.when(n % 3 == 0, "seeking_tutor").when(n % 3 == 1, "uncertain").otherwise("informational")
    topic = F.when(n % 4 == 0, "literature").when(n % 4 == 3, "russian_and_literature").when(n % 4 == 1, "other").otherwise("unknown")
    return items(spark, sf_dir).where(R.eligible(kind, topic, F.col("score"))).select("item_id", "score")


def immediate_topk(spark, sf_dir):
    reserved = table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("lead_id"))
    marked = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("event_id").alias("lead_id"))
    return S.immediate(leads(spark, sf_dir), reserved, marked).select(F.col("lead_id").alias("item_id"), "score", seconds("last_seen_at").alias("collected_s"))


def digest_candidates(spark, sf_dir):
    sent = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("lead_id"))
    return S.digest_candidates(leads(spark, sf_dir), sent).select(F.col("lead_id").alias("item_id"), "score", seconds("said_at").alias("at_s"))


def digest_statistics(spark, sf_dir):
    day = F.unix_date(F.to_date("collected_at")).cast("long").alias("day")
    rows = S.band_counts(items(spark, sf_dir), [day], BANDS, collected=F.lit(True), rejected=F.col("status") == "rejected")
    return rows.select("day", "collected", "rejected", "immediate", "digest")


def chunks(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("envelope_id"), F.col("turn").alias("position"), F.length("text").alias("n"))


def delivery_next_chunk(spark, sf_dir):
    rows = chunks(spark, sf_dir).withColumn("status", F.when(F.col("position") < F.col("envelope_id") % 4, "sent").otherwise("pending"))
    return S.next_chunks(rows).select(F.col("envelope_id").alias("conv_id"), "chunks", "remaining", F.coalesce("next", F.lit(-1)).alias("next_turn"))


def delivery_tallies(spark, sf_dir):
    rows = chunks(spark, sf_dir).withColumn("outcome", F.when(F.col("n") % 7 == 0, "failed").when(F.col("n") % 5 == 0, "deferred").otherwise("sent"))
    return S.outcome_tallies(rows, ("failed", "deferred", "sent"))


def delivery_backoff(spark, sf_dir):
    n = F.col("event_id")
    return table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", O.backoff(n % 12, (n % 400).cast("double"), F.lit(0.0)).cast("long").alias("wait_s"))


def feedback_latest(spark, sf_dir):
    rows = callbacks(spark, sf_dir)
    return rows.groupBy("lead", "actor").agg(F.max_by("choice", "callback_id").alias("choice"))


def feedback_ledger(spark, sf_dir):
    """The answers that changed something, by sorted folds of each lead; see `streaming.feedback` for the stream."""
    from rillflow.streaming.feedback import ledger_of

    rows = callbacks(spark, sf_dir)
    return ledger_of(rows.union(rows.where("callback_id % 5 = 0")))


def feedback_lead_status(spark, sf_dir):
    last = callbacks(spark, sf_dir).groupBy("lead").agg(F.max_by("choice", "callback_id").alias("choice"))
    return last.select("lead", F.when(F.col("choice") == "not_relevant", "rejected").otherwise(F.col("choice")).alias("status"))


def retention_plan(spark, sf_dir):
    retained = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("item_id")).union(table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id"))
    sources = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("source_key")).agg((5 + F.min("doc_id") % 7).cast("int").alias("retention_days"))
    return E.expired_raw(items(spark, sf_dir), sources, retained, at(F.lit(864000)), E.Periods(rejected=6, leads=9)).select("item_id", "status")


def retention_counts(spark, sf_dir):
    return items(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("collected_at") < at(F.lit(20000))).alias("expired"))


def retention_references(spark, sf_dir):
    """Orders as leads, returned lines as what refers to them."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    returned = lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return orders.where("o_totalprice > 100000").join(returned, "o_orderkey", "left_semi").select(F.col("o_orderkey").alias("item_id"))


def band_by_priority(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"), F.min("o_orderkey").alias("first_order"))


def lead_source_join(spark, sf_dir):
    read = lambda name: table(spark, sf_dir, name)
    orders = read("orders").where("o_orderstatus = 'O'").withColumnRenamed("o_custkey", "c_custkey")
    places = read("nation").withColumnRenamed("n_regionkey", "r_regionkey").join(read("region"), "r_regionkey").withColumnRenamed("n_nationkey", "c_nationkey")
    return orders.join(read("customer"), "c_custkey").join(places, "c_nationkey").groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("leads"))


def canonical_by_rank(spark, sf_dir):
    order = [F.desc("l_quantity"), F.desc("l_discount"), F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")]
    return dedup.representative(table(spark, sf_dir, "lineitem"), "l_orderkey", order).select("l_orderkey", "l_linenumber", "l_partkey")


def seen_window(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_orderkey").alias("first_seen"), F.max("l_orderkey").alias("last_seen"), F.count_distinct("l_suppkey").alias("sources"))


def source_quality_metrics(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    known = {"labelled": F.col("quality").isNotNull() | F.col("toxic").isNotNull(), "good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("items"), *(F.count_if(c).alias(name) for name, c in known.items()))


QUERIES = {
    f.__name__: f
    for f in (
        source_gates, source_upsert, ingest_first_wins, ingest_high_water, checkpoint_prefix, run_status, run_totals, latest_run_per_source, claim_order_topk, failed_list, failed_reset, status_counts, score_bands, eligible_items,
        immediate_topk, digest_candidates, digest_statistics, delivery_next_chunk, delivery_tallies, delivery_backoff, feedback_latest, feedback_ledger, feedback_lead_status, retention_plan, retention_counts, retention_references,
        band_by_priority, lead_source_join, canonical_by_rank, seen_window, source_quality_metrics,
    )
}

# What follows states the same results for DuckDB, apart from the operators.
#: Records, their processing state and a score.
ITEMS = """items AS (
  SELECT doc_id AS item_id, source, n_chars, doc_id * 60 AS collected_s,
         CASE WHEN doc_id % 10 = 0 THEN NULL ELSE doc_id * 60 - (doc_id % 40) * 86400 END AS published_s,
         CASE WHEN doc_id % 7 = 0 THEN 'rejected' WHEN doc_id % 11 = 0 THEN 'failed'
              WHEN doc_id % 13 = 0 THEN 'pending' ELSE 'processed' END AS status,
         (doc_id * 37) % 101 AS score,
         CASE WHEN doc_id % 5 = 0 THEN 'notified' WHEN doc_id % 5 = 1 THEN 'rejected' ELSE 'new' END AS lead_status
  FROM documents)"""
RUNS = """runs AS (
  SELECT event_id AS run_id, user_id, event_type, 1 + event_id % 9 AS seen,
         CASE event_type WHEN 'error' THEN 1 + event_id % 9 ELSE event_id % 3 END AS failed
  FROM events)"""
CALLBACKS = """callbacks AS (
  SELECT event_id AS callback_id, user_id AS actor, event_id % 97 AS lead,
         CASE event_type WHEN 'click' THEN 'interested' WHEN 'error' THEN 'not_relevant'
              WHEN 'view' THEN 'duplicate' WHEN 'purchase' THEN 'closed' END AS choice
  FROM events WHERE event_type IN ('click', 'error', 'view', 'purchase'))"""

SQL = {
    # Scans, gates and upserts
    "source_gates": """
WITH s AS (SELECT source, count(*) AS items, min(doc_id) AS first_id FROM documents GROUP BY source),
gated AS (SELECT source, items, first_id % 2 = 0 AS enabled, first_id % 3 <> 0 AS approved, CASE WHEN first_id % 4 = 0 THEN 5000 END AS paused_until_s FROM s)
SELECT source, items FROM gated WHERE enabled AND approved AND (paused_until_s IS NULL OR paused_until_s <= 1000)""",
    "source_upsert": """
WITH old AS (SELECT source, min(doc_id) AS config FROM documents WHERE doc_id % 2 = 0 GROUP BY source),
new AS (SELECT source, max(doc_id) AS config FROM documents WHERE doc_id % 3 = 0 GROUP BY source)
SELECT coalesce(n.source, o.source) AS source, coalesce(n.config, o.config) AS config,
       CASE WHEN o.source IS NULL THEN 'inserted' WHEN n.source IS NULL THEN 'kept' ELSE 'updated' END AS action
FROM old o FULL OUTER JOIN new n ON o.source = n.source""",
    # Ingest: the first version of a record wins; a replay of old records changes nothing
    "ingest_first_wins": """
WITH arrivals AS (
  SELECT doc_id AS external_id, source, n_chars, doc_id AS arrived FROM documents
  UNION ALL SELECT doc_id, source, n_chars + 1, 1000000000 + doc_id FROM documents WHERE doc_id % 3 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source, external_id ORDER BY arrived) AS k FROM arrivals)
SELECT source, external_id, n_chars FROM ranked WHERE k = 1""",
    "ingest_high_water": """
WITH """ + ITEMS + """
SELECT source, count(*) AS inserted, coalesce(max(published_s), -1) AS high_water_s FROM items GROUP BY source""",
    "checkpoint_prefix": """
WITH pages AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS bad FROM events),
running AS (SELECT *, sum(bad) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bad_so_far FROM pages)
SELECT user_id, count(*) AS pages, coalesce(max(CASE WHEN bad_so_far = 0 THEN event_id END), -1) AS cursor_at, CAST(sum(bad) AS BIGINT) AS failed FROM running GROUP BY user_id""",
    "run_status": """
WITH """ + RUNS + """
SELECT run_id, CASE WHEN failed = 0 THEN 'succeeded' WHEN seen > failed THEN 'partial' ELSE 'failed' END AS status FROM runs""",
    "run_totals": """
WITH """ + RUNS + """
SELECT user_id, CAST(sum(seen) AS BIGINT) AS seen, CAST(sum(failed) AS BIGINT) AS failed, max(run_id) AS last_run FROM runs GROUP BY user_id""",
    "latest_run_per_source": """
WITH sources AS (SELECT DISTINCT source, CAST(substr(source, 4) AS BIGINT) AS n FROM documents), """ + RUNS + """,
ranked AS (SELECT user_id, run_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY run_id DESC) AS k FROM runs)
SELECT source, coalesce(run_id, -1) AS run_id, coalesce(event_type, 'never_run') AS state FROM sources LEFT JOIN (SELECT * FROM ranked WHERE k = 1) r ON r.user_id = sources.n""",
    # Work selection and counts
    "claim_order_topk": """
WITH """ + ITEMS + """
SELECT item_id, collected_s FROM items WHERE status = 'pending' ORDER BY collected_s, item_id LIMIT 100""",
    "failed_list": """
WITH """ + ITEMS + """
SELECT item_id, collected_s FROM items WHERE status = 'failed' ORDER BY collected_s, item_id LIMIT 50""",
    "failed_reset": """
WITH """ + ITEMS + """,
picked AS (SELECT item_id FROM items WHERE status = 'failed' ORDER BY collected_s, item_id LIMIT 1000)
SELECT i.item_id, CASE WHEN p.item_id IS NULL THEN i.status ELSE 'pending' END AS status FROM items i LEFT JOIN picked p ON p.item_id = i.item_id""",
    "status_counts": """
WITH """ + ITEMS + """, names AS (SELECT 'pending' AS status UNION ALL SELECT 'processed' UNION ALL SELECT 'rejected' UNION ALL SELECT 'failed')
SELECT n.status, count(i.item_id) AS items FROM names n LEFT JOIN items i ON i.status = n.status GROUP BY n.status""",
    "score_bands": """
WITH """ + ITEMS + """
SELECT source, count(CASE WHEN score >= 90 THEN 1 END) AS immediate, count(CASE WHEN score >= 55 AND score < 90 THEN 1 END) AS digest,
       count(CASE WHEN score >= 45 AND score < 55 THEN 1 END) AS review FROM items GROUP BY source""",
    "eligible_items": """
WITH """ + ITEMS + """
SELECT item_id, score FROM items WHERE item_id % 3 <> 2 AND item_id % 4 IN (0, 3) AND score >= 45""",
    # Delivery
    "immediate_topk": """
WITH """ + ITEMS + """
SELECT i.item_id, i.score, i.collected_s FROM items i
WHERE i.score >= 90 AND i.lead_status IN ('new', 'notified')
  AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = i.item_id AND l.quality = 0)
  AND NOT EXISTS (SELECT 1 FROM events e WHERE e.event_id = i.item_id AND e.event_type = 'error')
ORDER BY i.score DESC, i.collected_s DESC, i.item_id LIMIT 100""",
    "digest_candidates": """
WITH """ + ITEMS + """, sent AS (SELECT doc_id AS item_id FROM labels WHERE toxic = 1)
SELECT i.item_id, i.score, coalesce(i.published_s, i.collected_s) AS at_s FROM items i ANTI JOIN sent ON sent.item_id = i.item_id
WHERE i.score >= 55 AND i.lead_status IN ('new', 'notified', 'interested')""",
    "digest_statistics": """
WITH """ + ITEMS + """
SELECT CAST(floor(collected_s / 86400) AS BIGINT) AS day, count(*) AS collected, count(CASE WHEN status = 'rejected' THEN 1 END) AS rejected,
       count(CASE WHEN score >= 90 THEN 1 END) AS immediate, count(CASE WHEN score >= 55 AND score < 90 THEN 1 END) AS digest
FROM items GROUP BY CAST(floor(collected_s / 86400) AS BIGINT)""",
    "delivery_next_chunk": """
WITH chunks AS (SELECT conv_id, turn, CASE WHEN turn < conv_id % 4 THEN 'sent' ELSE 'pending' END AS status FROM conversations)
SELECT conv_id, count(*) AS chunks, count(CASE WHEN status <> 'sent' THEN 1 END) AS remaining, coalesce(min(CASE WHEN status <> 'sent' THEN turn END), -1) AS next_turn FROM chunks GROUP BY conv_id""",
    "delivery_tallies": """
WITH sent AS (SELECT conv_id, min(CASE WHEN length(text) % 7 = 0 THEN 0 WHEN length(text) % 5 = 0 THEN 1 ELSE 2 END) AS worst FROM conversations GROUP BY conv_id)
SELECT CASE worst WHEN 0 THEN 'failed' WHEN 1 THEN 'deferred' ELSE 'sent' END AS outcome, count(*) AS envelopes FROM sent GROUP BY worst""",
    "delivery_backoff": """
SELECT event_id, CAST(greatest(event_id % 400, least(300, power(2, event_id % 12))) AS BIGINT) AS wait_s FROM events WHERE event_type = 'error'""",
    # Feedback
    "feedback_latest": """
WITH """ + CALLBACKS + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY lead, actor ORDER BY callback_id DESC) AS k FROM callbacks)
SELECT lead, actor, choice FROM ranked WHERE k = 1""",
    "feedback_ledger": """
WITH """ + CALLBACKS + """, replayed AS (SELECT * FROM callbacks UNION ALL SELECT * FROM callbacks WHERE callback_id % 5 = 0),
once AS (SELECT DISTINCT callback_id, actor, lead, choice FROM replayed),
seen AS (SELECT *, lag(choice) OVER (PARTITION BY lead, actor ORDER BY callback_id) AS before, lag(choice) OVER (PARTITION BY lead ORDER BY callback_id) AS state FROM once)
SELECT callback_id, actor, lead, choice FROM seen WHERE before IS NULL OR before <> choice OR state <> choice""",
    "feedback_lead_status": """
WITH """ + CALLBACKS + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY lead ORDER BY callback_id DESC) AS k FROM callbacks)
SELECT lead, CASE choice WHEN 'not_relevant' THEN 'rejected' ELSE choice END AS status FROM ranked WHERE k = 1""",
    # Retention
    "retention_plan": """
WITH """ + ITEMS + """, protected AS (
  SELECT doc_id AS item_id FROM labels WHERE toxic = 1 UNION SELECT event_id FROM events WHERE event_type = 'purchase'),
days AS (SELECT source, 5 + min(doc_id) % 7 AS keep_days FROM documents GROUP BY source)
SELECT i.item_id, i.status FROM items i JOIN days d ON d.source = i.source ANTI JOIN protected p ON p.item_id = i.item_id
WHERE i.status IN ('rejected', 'processed') AND i.collected_s < 864000 - least(d.keep_days, CASE WHEN i.status = 'rejected' THEN 6 ELSE 9 END) * 86400""",
    "retention_counts": """
WITH """ + ITEMS + """
SELECT status, count(*) AS items, count(CASE WHEN collected_s < 20000 THEN 1 END) AS expired FROM items GROUP BY status""",
    "retention_references": """
SELECT o.o_orderkey AS item_id FROM orders o SEMI JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R' WHERE o.o_totalprice > 100000""",
    # Relational forms on the star schema
    "band_by_priority": """
SELECT o_orderpriority, count(*) AS orders, min(o_orderkey) AS first_order FROM orders GROUP BY o_orderpriority""",
    "lead_source_join": """
SELECT n.n_name, r.r_name, count(*) AS leads FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
JOIN region r ON r.r_regionkey = n.n_regionkey WHERE o.o_orderstatus = 'O' GROUP BY n.n_name, r.r_name""",
    "canonical_by_rank": """
WITH ranked AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_discount DESC, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey FROM ranked WHERE k = 1""",
    "seen_window": """
WITH groups AS (SELECT l_partkey, l_suppkey, l_orderkey FROM lineitem)
SELECT l_partkey, min(l_orderkey) AS first_seen, max(l_orderkey) AS last_seen, count(DISTINCT l_suppkey) AS sources FROM groups GROUP BY l_partkey""",
    "source_quality_metrics": """
SELECT d.source, count(*) AS items, count(l.doc_id) AS labelled, count(CASE WHEN l.quality = 1 THEN 1 END) AS good, count(CASE WHEN l.toxic = 1 THEN 1 END) AS toxic
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.source""",
}
