import datetime
import html
import random
import time

import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillflow.functions import outcomes as O
from rillflow.functions import presentation as P
from rillflow.operators import delivery, selection
from rillflow.operators.replay import replay
from rillflow.streaming.feedback import CHOICES, feedback_available, ledger_of, step
from rillflow.streaming.ingest import ingest_available

NOW = datetime.datetime(2026, 3, 29, 10, tzinfo=datetime.timezone.utc)


def one(spark, column, **values):
    values = values or {"x": 1}
    schema = ", ".join(f"{k} {'timestamp' if isinstance(v, datetime.datetime) else 'long' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@given(st.text(max_size=60), st.integers(1, 80))
def test_safe_text_is_a_prefix_within_its_budget(text, budget):
    got = P.safe(text, budget)
    assert P.units(got) <= budget
    printable = P.UNPRINTABLE.sub(" ", text)
    whole = html.unescape(got.removesuffix("…")) if got != html.escape(printable) else printable
    assert printable.startswith(whole) or "&" in text


def test_safe_text_keeps_clusters_and_entities_whole():
    assert P.safe("a<b>", 6) == "a&lt;…"
    assert P.safe("a<b>", 5) == "a…"
    assert P.safe("xé", 3) == "x…"
    assert P.safe("👩‍👩", 5) == "…" and P.safe("🇷🇺🇷", 6) == "🇷🇺…"
    assert P.safe("a\x00b\n", 10) == "a b\n" and P.safe(None) == ""


def test_card_leaves_out_what_is_unknown(spark):
    schema = (
        "score int, subject string, grade int, goals array<string>, format string, urgency string, location string, budget string, reason_ids array<string>, "
        "source string, published_at timestamp, is_snippet boolean, excerpt string, url string"
    )
    full = (61, "literature", 9, ["ege", "new"], "online", "high", "<Пермь>", "1 руб", ["fresh", "odd", "exam", "online"], "s&t", NOW - datetime.timedelta(hours=2), True, "текст", "https://a.b/?x=1&y=2")
    bare = (0, None, None, [], "unknown", "unknown", None, "", [], None, None, False, None, None)
    a, b = (r[0] for r in spark.createDataFrame([(full,), (bare,)], f"l struct<{schema.replace(' ', ':').replace(',:', ',')}>").select(P.card(F.col("l"), F.lit(NOW))).collect())
    assert a.split("\n") == [
        "<b>61/100</b> · литература · 9 класс · ЕГЭ · цель не указана · онлайн · срочно", "Место: &lt;Пермь&gt;", "Бюджет: 1 руб",
        "Почему подходит: свежее объявление; дополнительный фактор оценки; подготовка к ЕГЭ или ОГЭ", "s&amp;t · 2 ч назад",
        "Фрагмент поисковой выдачи, не полный текст объявления:", "текст", '<a href="https://a.b/?x=1&amp;y=2">Открыть оригинал</a>',
    ]
    assert b.split("\n") == ["<b>0/100</b> · предмет не указан", "Почему подходит: нет данных", " · время публикации неизвестно", ""]


def test_digest_closes_on_length_and_on_buttons():
    rows = pd.DataFrame({"envelope_id": 1, "header": "h", "rank": range(25), "card": "c" * 10})
    by_buttons = delivery.digest_messages(rows)
    assert by_buttons.n_cards.tolist() == [20, 5] and by_buttons.n_buttons.tolist() == [80, 20]
    assert by_buttons.body[1].startswith("Продолжение дайджеста\n\n<b>Заявка 21</b>")
    by_length = delivery.digest_messages(rows, limit=100)
    assert (by_length.units <= 100).all() and by_length.n_cards.sum() == 25
    empty = delivery.digest_messages(pd.DataFrame({"envelope_id": [1], "header": ["h"], "rank": [0], "card": [None]}))
    assert empty.body.tolist() == ["h"] and empty.n_cards.tolist() == [0]


def test_claims(spark):
    envelopes = [
        ("sent", "sent", None, False, False, False), ("paused", "pending", None, False, True, False), ("asked", "pending", None, False, True, True), ("gone", "pending", None, True, False, False),
        ("closed", "pending", "closed", False, False, False), ("none", "pending", None, False, False, False), ("all", "pending", "new", False, False, False), ("broken", "pending", None, False, False, False),
        ("tired", "failed", None, False, False, False), ("fatal", "failed", None, False, False, False), ("later", "failed", None, False, False, False), ("due", "failed", None, False, False, False),
    ]
    hour = datetime.timedelta(hours=1)
    chunks = [("asked", 0, "sent", None, 1, None), ("asked", 1, "pending", None, 0, None), ("asked", 2, "ambiguous", None, 1, None), ("all", 0, "sent", None, 1, None), ("broken", 0, "sending", None, 1, None),
              ("tired", 0, "failed", "retryable", 3, None), ("fatal", 0, "failed", "malformed", 1, None), ("later", 0, "failed", "retryable", 1, NOW + hour), ("due", 0, "failed", "rate_limited", 1, NOW)]
    e = spark.createDataFrame(envelopes, "envelope_id string, status string, lead_status string, lead_missing boolean, paused boolean, explicit boolean")
    c = spark.createDataFrame(chunks, "envelope_id string, position int, status string, last_error string, attempts int, next_attempt_at timestamp")
    got = {r.envelope_id: (r.action, r.position) for r in delivery.claim(e, c, F.lit(NOW)).collect()}
    assert got == {
        "sent": ("none", None), "paused": ("none", None), "asked": ("send", 1), "gone": ("skip", None), "closed": ("skip", None), "none": ("missing", None), "all": ("sent", None),
        "broken": ("ambiguous", 0), "tired": ("none", None), "fatal": ("none", None), "later": ("none", None), "due": ("send", 0),
    }


def test_times_need_an_offset(spark):
    values = ["2026-01-01T12:00:00+03:00", "2026-01-01T12:00:00", "Thu, 01 Jan 2026 12:00:00 +0300", "1 Jan 2026 09:00 GMT", "yesterday", None]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(F.unix_timestamp(O.explicit_time(F.col("v")))).collect()
    assert [r[0] for r in rows] == [1767258000, None, 1767258000, 1767258000, None, None]


def test_waits_are_bounded(spark):
    values = ["0", "300", "301", "-1", "x", "Sun, 29 Mar 2026 10:01:00 GMT", "Sun, 29 Mar 2026 09:59:00 GMT", None, "9" * 60]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(O.retry_delay(F.col("v"), F.lit(NOW))).collect()
    assert [r[0] for r in rows] == [0, 300, None, None, None, 60, None, None, None]
    assert one(spark, O.backoff(F.lit(3), F.lit(None).cast("double"), F.lit(0.5))) == 8.5
    assert one(spark, O.backoff(F.lit(20), F.lit(400.0), F.lit(0.5))) == 400.0


def test_kinds_of_failure(spark):
    assert one(spark, O.error_kind(F.col("c"), O.WALL_ERRORS), c=29) == "rate_limit_or_quota" and one(spark, O.error_kind(F.col("c"), O.SEARCH_ERRORS), c=999) == "provider_request"
    kinds = {("network", "connect_error"): "retryable", ("network", "read_error"): "ambiguous", ("timeout", "pool_timeout"): "retryable", ("forbidden", ""): "authorization", ("odd", ""): "ambiguous"}
    assert all(one(spark, O.delivery_error(F.col("e"), F.col("c")), e=e, c=c) == kind for (e, c), kind in kinds.items())


def test_callbacks_are_strict(spark):
    good = "i:" + "0f" * 16
    for data, number, expected in [(good, "1", ("i", "0f" * 16)), (good + "\n", "1", None), (good.upper(), "1", None), ("x" + good[1:], "1", None), (good, "", None), (good, "9" * 129, None)]:
        got = one(spark, P.callback(F.col("d"), F.col("n")), d=data, n=number)
        assert (got and tuple(got)) == expected


def test_feedback_in_batches_is_feedback_at_once(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.randrange(3), rng.choice(list(CHOICES) + ["other"])) for i in range(200)]
    for start in range(0, 200, 50):  # each file replays some of the one before
        frame = spark.createDataFrame(rows[max(0, start - 10) : start + 50], "event_id long, user_id long, event_type string")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    got = lambda **kw: sorted(tuple(r) for r in feedback_available(spark, str(tmp_path / "events.parquet"), leads=2, **kw).collect())
    state, whole = {}, []
    answers = pd.DataFrame([(i, u, i % 2, CHOICES[t]) for i, u, t in rows if t in CHOICES], columns=["callback_id", "actor", "lead", "choice"])
    for _, own in answers.groupby("lead"):
        whole += step({}, own)
    assert got() == sorted(whole) == got(files_per_trigger=1) and 0 < len(whole) < len(answers)
    assert sorted(tuple(r) for r in ledger_of(spark.createDataFrame(pd.concat([answers, answers.tail(20)]))).collect()) == sorted(whole)


def test_the_first_arrival_stays(spark, tmp_path):
    for k, rows in enumerate([[(1, "a"), (1, "b"), (2, "z")], [(1, "0"), (3, "c"), (None, "n")]]):
        spark.createDataFrame(rows, "k long, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in.parquet"))
        time.sleep(1.1)
    got = ingest_available(spark, str(tmp_path / "in.parquet"), ("k",), target=str(tmp_path / "out"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a"), (2, "z"), (3, "c")]


def test_a_finished_chunk_moves_its_envelope_and_lead(spark):
    make, now = spark.createDataFrame, F.timestamp_seconds(F.lit(1000))
    envelopes = make([(1, 7, "sending"), (2, 8, "sending"), (3, None, "sending")], "envelope_id long, lead_id long, status string").selectExpr("*", "CAST(NULL AS STRING) message_id", "'old' last_error", "CAST(NULL AS TIMESTAMP) sent_at")
    chunks = make([(1, 0, "sent", 1), (1, 1, "sending", 1), (2, 0, "sending", 2), (3, 0, "sending", 3)], "envelope_id long, position int, status string, attempts int").selectExpr("envelope_id", "position", "status", "CAST(NULL AS STRING) message_id", "CAST(NULL AS STRING) last_error", "attempts", "CAST(NULL AS TIMESTAMP) next_attempt_at", "CAST(NULL AS TIMESTAMP) sent_at")
    leads = make([(7, "new"), (8, "new"), (9, "new")], "lead_id long, status string")
    results = make([(1, 1, "m1", None, 0.0), (2, 0, None, "rate_limited", 90.0), (3, 0, None, "ambiguous", 0.0)], "envelope_id long, position int, message_id string, error string, retry_after double")
    e, c, known = delivery.finish(envelopes, chunks, leads, results, now)
    assert {r.envelope_id: (r.status, r.message_id, r.last_error) for r in e.collect()} == {1: ("sent", "m1", None), 2: ("failed", None, "rate_limited"), 3: ("failed", None, "ambiguous")}
    assert {(r.envelope_id, r.position): (r.status, r.due) for r in c.withColumn("due", F.unix_timestamp("next_attempt_at")).collect()} == {(1, 0): ("sent", None), (1, 1): ("sent", None), (2, 0): ("failed", 1090), (3, 0): ("ambiguous", None)}
    assert {r.lead_id: r.status for r in known.collect()} == {7: "notified", 8: "new", 9: "new"}


def test_selectors_and_pauses(spark):
    items = spark.createDataFrame([(1, "failed", 5), (2, "failed", 4), (3, "pending", 1)], "item_id long, status string, collected_at long")
    again = lambda **kw: {r.item_id for r in selection.reset_failed(items, **kw).where("status = 'pending'").collect()}
    assert again(item_id=1) == {1, 3} and again(limit=1) == {2, 3} and again(item_id=3) == {3}
    for bad in ({}, {"item_id": 1, "limit": 1}, {"limit": 0}, {"limit": 1001}):
        with pytest.raises(ValueError):
            selection.reset_failed(items, **bad)
    old = spark.createDataFrame([("a", True), ("b", False)], "recipient string, paused boolean")
    changes = spark.createDataFrame([("a", True, 1), ("a", False, 2), ("c", True, 1)], "recipient string, paused boolean, at long")
    assert {r.recipient: r.paused for r in selection.set_paused(old, changes).collect()} == {"a": False, "b": False, "c": True}
    none = selection.reserve_immediate(*[spark.range(0)] * 3, paused=True)
    assert none.columns == ["lead_id", "envelope_id", "rank"] and not none.collect()


def item(i, **changes):
    base = {"item_id": i, "at": pd.Timestamp("2026-01-01") + pd.Timedelta(days=i), "published": None, "url": None, "kind": "a", "fingerprint": f"f{i}", "tokens": [f"{i}-{k}" for k in range(9)], "readable": None, "contacts": [], "eligible": True, "score": 50, "completeness": 1}
    empty = {"grade": None, "goals": None, "format": None, "location": None, "budget": None, "known_cluster": None, "known_face": None, "set_id": None}
    return base | empty | changes


def clusters(*items):
    none = pd.DataFrame({"x": [], "y": [], "similarity": []})
    return {r.item_id: (None if r.cluster_id is pd.NA else r.cluster_id, r.method, None if r.canonical_id is pd.NA else r.canonical_id) for r in replay(pd.DataFrame(list(items)), none).itertuples()}


def test_the_best_item_speaks_for_its_cluster():
    same = {"fingerprint": "f", "tokens": ["t"]}
    got = clusters(item(1, **same), item(2, **same, score=70), item(3, **same, score=70), item(4, **same, score=90, eligible=False))
    assert {v[2] for v in got.values()} == {2} and {v[0] for v in got.values()} == {1}


def test_a_promoted_kind_decides_later_matches():
    got = clusters(item(1, url="u"), item(2, url="u", kind="b", score=80), item(3, fingerprint="f1", tokens=["1-0"]))
    assert got[2][0] == 1 and got[3][0] == 3


def test_rejected_items_come_in_with_an_eligible_one():
    got = clusters(
        item(1, url="u", eligible=False), item(2, fingerprint="f", eligible=False), item(3, fingerprint="f", kind="b", eligible=False), item(4, fingerprint="f", contacts=["x"], eligible=False),
        item(5, url="u", fingerprint="f", contacts=["y"]), item(40, fingerprint="f", kind="c", eligible=False),
    )
    assert got[1] == (5, "exact_url", 5) and got[2] == (5, "exact_text", 5)
    assert got[3][0] is None and got[4][0] is None and got[40][0] is None


def test_conflicting_fields_keep_texts_apart():
    got = clusters(item(1, fingerprint="f", grade=9), item(2, fingerprint="f", grade=8), item(3, fingerprint="f", goals=["x"]))
    assert got[2][0] == 2 and got[3][0] == 1
