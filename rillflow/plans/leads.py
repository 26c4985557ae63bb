"""The whole way from records to leads, over the fixed requests and over documents that quote them."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from rillflow.functions import rules as R
from rillflow.functions import text as T
from rillflow.operators import process as O
from rillflow.operators.cluster_store import ClusterStore
from rillflow.operators.lineage import cut, shared_folder
from rillflow.operators.replay import cluster_items
from rillflow.sources.fixture import FIXTURE_TIME, TEXTS, fixture_pages
from rillflow.sources.records import table

#: An hour after the fixed requests.
NOW = "2026-01-01 13:00:00"


def fixture_items(spark):
    """All pages of both sets as pending items, in the order in which they come."""
    pages = [page.items for key, dataset in (("fixture", "primary"), ("fixture_crosspost", "crosspost")) for page in fixture_pages(spark, key, dataset)]
    rows = reduce(lambda a, b: a.union(b), pages)
    number = F.regexp_extract("external_id", r"(\d+)$", 1).cast("long")
    return rows.select((number + F.when(F.col("source_key") == "fixture", 0).otherwise(len(TEXTS["primary"]))).alias("item_id"), "*", F.lit("pending").alias("processing_status"))


def golden(spark):
    items, failed = O.process_pending(fixture_items(spark), F.lit(NOW).cast("timestamp"))
    items = cut(items)
    return items, cut(O.cluster(items)), failed


def golden_pipeline(spark, sf_dir):
    """What becomes of the fixed requests, in numbers."""
    items, clusters, failed = golden(spark)
    back = O.written_back(items, clusters)
    occurrences = O.occurrences(clusters)
    counts = back.agg(F.count(F.lit(1)).alias("raw"), F.count_if(F.col("processing_status") == "processed").alias("processed"), F.count_if(F.col("processing_status") == "rejected").alias("rejected"))
    methods = occurrences.agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("lead_id").alias("leads"), F.count_if(F.col("match_method") == "exact_text").alias("exact_text"), F.count_if(F.col("match_method") == "fuzzy_text").alias("fuzzy_text"))
    return counts.join(methods).join(failed.agg(F.count(F.lit(1)).alias("failed")))  # three single rows


def golden_items(spark, sf_dir):
    """Each fixed request with its intent, subject, score and completeness."""
    items, _, _ = golden(spark)
    return items.select("item_id", "intent", "subject", "score", "completeness", "eligible")


def golden_leads(spark, sf_dir):
    """The leads of the fixed requests: faces, fields, members."""
    items, clusters, _ = golden(spark)
    f = F.col("fields")
    return O.leads(clusters, items).select("lead_id", "canonical_item_id", "score", "subject", f["grade"].alias("grade"), F.array_join(f["goals"], "|").alias("goals"), f["format"].alias("format"), "occurrences", F.unix_timestamp("last_seen_at").alias("last_seen_s"))


def quoted_items(spark, sf_dir):
    """Documents as records that quote one of the fixed requests; every fifth says a word more."""
    n = F.col("doc_id")
    texts = F.array(*[F.lit(t) for t in TEXTS["primary"]])
    text = F.concat(F.get(texts, (n % len(TEXTS["primary"])).cast("int")), F.when(n % 5 == 0, " Спасибо.").otherwise(""), F.lit(" № "), (n % 50).cast("string"))
    at = F.timestamp_seconds(F.lit(1767268800) + n * 60)
    return table(spark, sf_dir, "documents").select(
        n.alias("item_id"), F.col("source").alias("source_key"), F.lit(None).cast("string").alias("url"), F.when(n % 3 == 0, at - F.make_interval(hours=(n % 40).cast("int"))).alias("published_at"), at.alias("collected_at"), text.alias("text"),
        F.when(n % 4 == 0, '{"response_available": true}').otherwise("{}").alias("metadata"),
    )


def request_scores(spark, sf_dir):
    """Intent, subject, fields, score and completeness of the quoted requests."""
    rows = O.process(quoted_items(spark, sf_dir), F.timestamp_seconds(F.lit(1767268800) + F.col("item_id") * 60))
    f = F.col("fields")
    return rows.select("item_id", "intent", "subject", "score", F.array_join(F.transform("reasons", lambda r: r["rule_id"]), "|").alias("reasons"), "completeness", f["grade"].alias("grade"), "eligible")


def extract_request_fields(spark, sf_dir):
    """The fields of the quoted requests."""
    answered = F.get_json_object("metadata", "$.response_available") == "true"
    rows = quoted_items(spark, sf_dir).withColumn("readable", T.readable(F.col("text"))).select("item_id", R.extract_fields(F.col("readable"), answered).alias("f"))
    return rows.select("item_id", "f.grade", F.array_join("f.goals", "|").alias("goals"), "f.format", F.coalesce("f.location_text", F.lit("-")).alias("location"), "f.urgency", F.coalesce("f.budget_text", F.lit("-")).alias("budget"), "f.contact_available", "f.closed")


def field_evidence(spark, sf_dir):
    """The matches that the fields of the quoted requests rest on, by rule."""
    found = R.field_spans()
    rows = quoted_items(spark, sf_dir).select("item_id", F.explode(found(T.readable(F.col("text")))).alias("m"))
    return rows.groupBy("m.rule_id").agg(F.count(F.lit(1)).alias("matches"), F.sum(F.col("m.end") - F.col("m.start")).alias("chars"))


def recoverable_items(spark, sf_dir):
    """Documents as pairs of one text: the earlier one has no score of its own."""
    n = F.col("doc_id")
    at = F.timestamp_seconds(F.lit(1767268800) + n * 60)
    pair = F.floor(n / 2)
    words = F.concat(F.lit("w"), pair.cast("string"))
    return table(spark, sf_dir, "documents").select(
        n.alias("item_id"), at.alias("at"), F.when((n % 2 == 1) & (pair % 7 == 0), at + F.make_interval(days=F.lit(40))).alias("published"), F.lit(None).cast("string").alias("url"), F.lit("a").alias("kind"),
        F.sha2(words, 256).alias("fingerprint"), F.array(words, F.concat(words, F.lit("b"))).alias("tokens"), F.when(pair % 5 == 0, F.array(F.sha2(n.cast("string"), 256))).otherwise(F.array()).alias("contacts"), (n % 2 == 1).alias("eligible"),
    )


def recovered(found):
    return found.select("item_id", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"), F.coalesce("method", F.lit("rejected")).alias("method"))


def rejected_recovery(spark, sf_dir):
    """Items rejected at first that a later request of the same text brings back: the earlier copy of each pair has no score of its own."""
    return recovered(cluster_items(recoverable_items(spark, sf_dir)))


def incremental_clusters(spark, sf_dir):
    """The same items in three batches, each on top of what is kept of those before; the pair at each border comes in two batches."""
    rows = recoverable_items(spark, sf_dir)
    first, last = rows.agg(F.min("item_id"), F.max("item_id")).first()
    store = ClusterStore(spark, f"{shared_folder(spark)}/clusters-{uuid.uuid4().hex}")
    first, last = (0, -1) if first is None else (first, last)
    third = (last - first) // 6 * 2 + 1  # an odd number of items: the pair at each border is split
    for low in range(first, last + 1, third):
        store.add(rows.where(F.col("item_id").between(low, low + third - 1)))
    return recovered(store.clusters())


QUERIES = {f.__name__: f for f in (request_scores, extract_request_fields, field_evidence, rejected_recovery, incremental_clusters)}

TEXT_LIST = "[" + ", ".join(f"'{t}'" for t in TEXTS["primary"]) + "]"
#: Of each fixed request: intent, subject, sum of its weights without freshness and contact, completeness without contact, grade.
KNOWN = (
    ("seeking_tutor", "literature", 25 + 30 + 10 + 8 + 4, 3, 10, "seeking_tutor|literature|exam|online|grade_stated"),
    ("offering_tutoring", "literature", 30 - 70, 0, None, "literature|offering_tutoring"),
    ("teaching_job", "literature", 30 - 35, 0, None, "literature|teaching_job"),
    ("seeking_tutor", "literature", 25 + 30, 0, None, "seeking_tutor|literature"),
    ("seeking_tutor", "literature", 25 + 30 + 10 + 8 + 4 + 3, 4, 9, "seeking_tutor|literature|exam|online|grade_stated|budget_stated"),
    ("seeking_tutor", "literature", 25 + 30 + 12 + 8 + 4, 4, 11, "seeking_tutor|literature|olympiad|online|grade_stated"),
    ("seeking_tutor", "russian_and_literature", 25 + 15 + 10 + 8 + 4 + 3, 4, 10, "seeking_tutor|russian_and_literature|exam|online|grade_stated|budget_stated"),
    ("uncertain", "literature", 30, 0, None, "literature"),
    ("school_or_agency_ad", "literature", 30 - 55, 0, None, "literature|school_or_agency_ad"),
    ("informational", "literature", 30, 0, None, "literature"),
    ("seeking_tutor", "other", 25 + 4, 1, 8, "seeking_tutor|grade_stated"),
    ("seeking_tutor", "literature", 25 + 30 + 10 + 8 + 4, 3, 10, "seeking_tutor|literature|exam|online|grade_stated"),
    ("seeking_tutor", "literature", 25 + 30 + 10 + 8 + 4, 4, 10, "seeking_tutor|literature|exam|online|grade_stated"),
)
KNOWN_SQL = "known(k, intent, subject, base, complete, grade, reasons) AS (VALUES " + ", ".join(f"({i}, '{a}', '{b}', {c}, {d}, {'NULL' if e is None else e}, '{r}')" for i, (a, b, c, d, e, r) in enumerate(KNOWN)) + ")"
ELIGIBLE = "intent IN ('seeking_tutor', 'uncertain') AND subject IN ('literature', 'russian_and_literature') AND score >= 45"
#: What the fields of each fixed request are, and what they rest on: rule and length of the match.
FIELDS = {
    0: ("ege", "online", "-", "-"), 4: ("oge", "online", "-", "до 2000 руб за час"), 5: ("olympiad|vsosh", "online", "-", "-"), 6: ("ege", "online", "-", "до 2000 руб."), 11: ("ege", "online", "-", "-"), 12: ("ege", "online", "Москва", "-"),
}
RESTS_ON = {
    0: (("grade", 8), ("goal_ege", 3), ("format_online", 6)),
    4: (("grade", 7), ("goal_oge", 3), ("format_online", 6), ("budget", 18)),
    5: (("grade", 8), ("goal_olympiad", 9), ("goal_vsosh", 4), ("format_online", 6)),
    6: (("grade", 8), ("goal_ege", 3), ("format_online", 6), ("budget", 12)),
    10: (("grade", 7),),
    11: (("grade", 8), ("goal_ege", 3), ("format_online", 6)),
    12: (("grade", 8), ("goal_ege", 3), ("format_online", 6), ("location", 12)),
}
#: What the fixed requests must come to, for the tests.
GOLDEN = {
    "golden_pipeline": "SELECT 14 AS raw, 8 AS processed, 6 AS rejected, 8 AS occurrences, 6 AS leads, 1 AS exact_text, 1 AS fuzzy_text, 0 AS failed",
    "golden_items": f"""
WITH {KNOWN_SQL}, scored AS (
  SELECT k + 1 AS item_id, intent, subject, greatest(0, least(100, base + 6)) AS score, complete AS completeness FROM known UNION ALL
  SELECT 14, intent, subject, greatest(0, least(100, base + 6)), complete FROM known WHERE k = 12)
SELECT *, {ELIGIBLE} AS eligible FROM scored""",
    "golden_leads": """
SELECT * FROM (VALUES (1, 1, 83, 'literature', 10, 'ege', 'online', 2, 1767268800), (4, 4, 61, 'literature', NULL, '', 'unknown', 1, 1767268800), (5, 5, 86, 'literature', 9, 'oge', 'online', 1, 1767268800),
  (6, 6, 85, 'literature', 11, 'olympiad|vsosh', 'online', 1, 1767268800), (7, 7, 71, 'russian_and_literature', 10, 'ege', 'online', 1, 1767268800), (13, 13, 83, 'literature', 10, 'ege', 'online', 2, 1767268800)) AS t(lead_id, canonical_item_id, score, subject, grade, goals, format, occurrences, last_seen_s)""",
}
#: Reasons keep their order: freshness comes after the grade, the budget and the contact after it, the negative ones last.
SQL = {
    "request_scores": f"""
WITH {KNOWN_SQL}, rows AS (SELECT doc_id AS item_id, doc_id % 13 AS k, doc_id % 4 = 0 AS contact, doc_id % 3 = 0 AND doc_id % 40 < 12 AS fresh FROM documents),
scored AS (SELECT item_id, intent, subject, CAST(greatest(0, least(100, base + CASE WHEN fresh THEN 6 ELSE 0 END + CASE WHEN contact THEN 2 ELSE 0 END)) AS INT) AS score, reasons, fresh, contact,
  CAST(complete + CASE WHEN contact THEN 1 ELSE 0 END AS INT) AS completeness, CAST(grade AS INT) AS grade FROM rows JOIN known USING (k)),
listed AS (SELECT *, list_filter(string_split(reasons, '|'), lambda x: x NOT IN ('budget_stated', 'offering_tutoring', 'school_or_agency_ad', 'teaching_job')) AS before_, list_filter(string_split(reasons, '|'), lambda x: x = 'budget_stated') AS budget,
  list_filter(string_split(reasons, '|'), lambda x: x IN ('offering_tutoring', 'school_or_agency_ad', 'teaching_job')) AS last_ FROM scored)
SELECT item_id, intent, subject, score, completeness, grade, {ELIGIBLE} AS eligible,
  array_to_string(list_concat(before_, CASE WHEN fresh THEN ['fresh'] ELSE [] END, budget, CASE WHEN contact THEN ['contact_available'] ELSE [] END, last_), '|') AS reasons FROM listed""",
    "extract_request_fields": f"""
WITH {KNOWN_SQL}, fields(k, goals, format, location, budget) AS (VALUES {", ".join(f"({k}, '{a}', '{b}', '{c}', '{d}')" for k, (a, b, c, d) in FIELDS.items())})
SELECT doc_id AS item_id, CAST(grade AS INT) AS grade, coalesce(goals, '') AS goals, coalesce(format, 'unknown') AS format, coalesce(location, '-') AS location, 'unknown' AS urgency, coalesce(budget, '-') AS budget, doc_id % 4 = 0 AS contact_available, false AS closed
FROM documents JOIN known ON known.k = doc_id % 13 LEFT JOIN fields ON fields.k = doc_id % 13""",
    "field_evidence": f"""
WITH found(k, rule_id, n) AS (VALUES {", ".join(f"({k}, '{r}', {n})" for k, rows in RESTS_ON.items() for r, n in rows)})
SELECT rule_id, count(*) AS matches, CAST(sum(n) AS BIGINT) AS chars FROM documents JOIN found ON found.k = doc_id % 13 GROUP BY rule_id""",
    "rejected_recovery": """
WITH d AS (SELECT doc_id, CAST(floor(doc_id / 2) AS BIGINT) AS pair, doc_id % 2 = 1 AS eligible FROM documents),
e AS (SELECT pair, doc_id FROM d WHERE eligible)
SELECT d.doc_id AS item_id, CASE WHEN d.eligible THEN d.doc_id WHEN e.doc_id IS NOT NULL AND d.pair % 7 <> 0 AND d.pair % 5 <> 0 THEN e.doc_id ELSE -1 END AS cluster_id,
  CASE WHEN d.eligible THEN 'exact_id' WHEN e.doc_id IS NOT NULL AND d.pair % 7 <> 0 AND d.pair % 5 <> 0 THEN 'exact_text' ELSE 'rejected' END AS method
FROM d LEFT JOIN e ON e.pair = d.pair""",
}
SQL["incremental_clusters"] = SQL["rejected_recovery"]
