import base64
import datetime
import json
import logging

import pytest
from pyspark.sql import functions as F

from rillflow.operators.delivery import Recipient, reserve_digest
from rillflow.sources import gates
from rillflow.sources import fixture, wall
from rillflow.sources.search import ROOT, search_results
from rillflow.sources.wall import decode_windows
from rillflow.streaming.log import JsonLines

NOW = datetime.datetime(2026, 1, 1, tzinfo=datetime.timezone.utc)


def response(xml):
    return json.dumps({"rawData": base64.b64encode(xml.encode()).decode()})


def test_search_responses(spark):
    doc = "<group><doc><url>%s</url><title>a<hl>b</hl></title><passages><passage>p%d</passage></passages><pubDate>%s</pubDate></doc></group>"
    good = f"<{ROOT}>" + doc % ("http://x.org/1", 1, "Thu, 01 Jan 2026 00:00:00 GMT") + doc % ("http://localhost/", 2, "") + doc % ("http://x.org/3", 3, "2026-01-01") + doc % ("http://x.org/4", 4, "") + f"</{ROOT}>"
    rows = [("good", response(good)), ("none", response(f'<{ROOT}><error code="15"/></{ROOT}>')), ("limit", response(f'<{ROOT}><error code="32"/></{ROOT}>')), ("odd", response(f'<{ROOT}><error code="?"/></{ROOT}>')), ("type", response(f"<!DOCTYPE r><{ROOT}/>")), ("root", response("<r/>")), ("text", "x"), ("list", "[]"), ("null", None)]
    results, failures = search_results(spark.createDataFrame(rows, "response_id string, payload string"), limit=3)
    got = results.select("response_id", "rank", "url", "evidence", F.unix_timestamp("published_at")).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [("good", 1, "http://x.org/1", "ab\np1", 1767225600), ("good", 3, "http://x.org/3", "ab\np3", None)]
    assert {r.response_id: r.failure for r in failures.collect()} == {"limit": "rate_limit", "odd": "provider_request", "type": "malformed_response", "root": "malformed_response", "text": "malformed_response", "list": "malformed_response", "null": "malformed_response"}


def test_a_window_holds_what_it_counts(spark):
    post = '{"id":%d,"owner_id":-1,"date":1,"text":"t","post_type":"post"}'
    rows = [(str(n), 1, '{"response":{"count":%d,"items":[%s,%s]}}' % (n, post % 5, post % 3)) for n in (1, 2, 9)]
    windows = spark.createDataFrame(rows, "window_id string, community_id long, payload string")
    ids = lambda **kw: sorted({r.window_id for r in decode_windows(windows, **kw).collect()})
    assert ids() == ["2", "9"] and ids(limit=2) == ["2", "9"] and ids(limit=3) == ["2"]


def test_closed_sources_are_not_read(spark):
    hour = datetime.timedelta(hours=1)
    base = {"key": "k", "kind": "a", "enabled": True, "policy_status": "approved"}
    cases = [({}, None), ({"enabled": False}, "disabled"), ({"policy_status": "x"}, "not_approved"), ({"authorized_until": NOW}, "authorization_expired"), ({"paused_until": NOW}, None), ({"paused_until": NOW + hour}, "paused")]
    for changes, reason in cases:
        assert gates.Source(**(base | changes)).closed(NOW) == reason
    assert gates.open_source(gates.Source(**base), {"a": lambda s: s.key}, NOW) == "k"
    for bad in ({"enabled": False}, {"kind": "b"}):
        with pytest.raises(ValueError):
            gates.open_source(gates.Source(**(base | bad)), {"a": lambda s: s.key}, NOW)
    rows = [(c.get("enabled", True), c.get("policy_status", "approved"), c.get("authorized_until"), c.get("paused_until")) for c, _ in cases] + [(None, None, None, None)]
    table = spark.createDataFrame(rows, "enabled boolean, policy_status string, authorized_until timestamp, paused_until timestamp")
    assert [r[0] for r in table.select(gates.may_read(F.lit(NOW))).collect()] == [r is None for _, r in cases] + [False]


def test_a_lead_is_in_one_digest_of_a_recipient(spark):
    make = spark.createDataFrame
    leads = make([(1, 60, "new", 5), (2, 90, "new", 1), (3, 60, "notified", 9), (4, 50, "new", 1), (5, 99, "closed", 1)], "lead_id long, score int, status string, at long")
    recipients = [Recipient("a", "d1"), Recipient("b", "d1", paused=True), Recipient("c", "d1", paused=True, explicit=True), Recipient("d", "d1"), Recipient("e", "d1")]
    sent = make([("a", 2), ("z", 1)], "recipient string, lead_id long")
    got = reserve_digest(leads, sent, make([("d", "d1"), ("a", "d0")], "recipient string, period string"), make([("e", "d1")], "recipient string, period string"), recipients)
    assert sorted((r.recipient, r.lead_id, r.rank) for r in got.collect()) == [("a", 1, 2), ("a", 3, 1), ("c", 1, 3), ("c", 2, 1), ("c", 3, 2)]


def test_no_open_recipient_has_no_digest(spark):
    none = spark.createDataFrame([], "recipient string, period string, lead_id long")
    leads = spark.createDataFrame([(1, 60, "new", 5)], "lead_id long, score int, status string, at long")
    got = reserve_digest(leads, none.drop("period"), none.drop("lead_id"), none.drop("lead_id"), [Recipient("a", "d1", paused=True)])
    assert got.columns == ["recipient", "period", "lead_id", "rank"] and not got.collect()


def test_log_lines_hold_named_fields_only():
    record = logging.LogRecord("rillflow.x", logging.INFO, "f", 1, "run_done", ("secret",), None)
    record.items_seen, record.token = 3, "secret"
    line = json.loads(JsonLines().format(record))
    assert line.keys() == {"timestamp", "level", "event", "items_seen"} and line["event"] == "run_done"
    assert json.loads(JsonLines().format(logging.LogRecord("other", 20, "f", 1, "secret", (), None)))["event"] == "dependency_log"


def window(*posts, count=None, **more):
    return json.dumps({"response": {"count": len(posts) if count is None else count, "items": list(posts)}} | more)


def post(own_id, text="t", **more):
    return {"id": own_id, "owner_id": -1, "date": 5, "text": text, "post_type": "post"} | more


def test_windows_are_sound_or_refused():
    quoted = lambda k, text, history=(): {"id": k, "owner_id": 7, "text": text, "copy_history": list(history)}
    read = lambda payload, limit=None: wall.read_window(payload, 1, limit)
    deep = quoted(1, "a", [quoted(2, "b", [quoted(3, "a")])])
    got = read(window(post(9, "w", copy_history=[deep]), post(100, is_pinned=1), post(8, post_type="copy", text="")))
    assert got["failure"] is None and [p["post_id"] for p in got["posts"]] == [9, 100, 8]
    assert got["posts"][0]["text"] == "w\n\na\n\nb" and [o["post_id"] for o in got["posts"][0]["originals"]] == [1, 2, 3]
    bad = [
        window(post(8), post(9)), window(post(9), post(9)), window(post(9, is_pinned=1), post(8, is_pinned=1)), window(post(9, is_pinned=True)), window(post(9, post_type="ad")), window(post(9, owner_id=-2)),
        window(post(True)), window(post(0)), window(post(9, text=None)), window(post(9, text="\0")), window(post(9), count=0), window(post(9, copy_history=[quoted(1, "x", [deep])])), window(post(9, copy_history=[quoted(k, "x") for k in range(1, 7)])),
        '{"response":{"count":0,"items":[],"items":[]}}', '{"response":{"count":NaN,"items":[]}}', window(error={"error_code": 5}), "{}", "x", None, "[]",
    ]
    assert {read(b)["failure"] for b in bad} == {"malformed_response"}
    assert read(window(post(9, "x" * 65_537)))["failure"] == "response_too_large"
    assert read('{"error":{"error_code":5}}') == {"failure": "error", "code": 5, "posts": []}
    assert read(window(post(9), post(8)), 3)["failure"] is None and read(window(post(9), count=2), 3)["failure"] == "malformed_response"


def test_walls_are_read_on_from_their_marks(spark):
    rows = [("new", 1, window(post(9), post(8))), ("on", 2, window(*(post(k, owner_id=-2) for k in (9, 8, 3)))), ("gap", 3, window(post(99, owner_id=-3, is_pinned=1), post(9, owner_id=-3))), ("none", 4, window()), ("bad", 5, "x")]
    decoded = wall.decode(spark.createDataFrame(rows, "window_id string, community_id long, payload string"))
    cursors = spark.createDataFrame([(2, 7), (3, 5), (5, 6)], "community_id long, mark long")
    items, marks = wall.read_on(decoded, cursors, 2, 2)
    assert sorted((r.community_id, r.post_id) for r in items.collect()) == [(1, 8), (1, 9), (2, 8), (2, 9)]
    assert {r.community_id: (r.mark, r.failure) for r in marks.collect()} == {1: (9, None), 2: (9, None), 3: (5, "cursor_overflow"), 4: (0, None), 5: (6, "malformed_response")}
    sources = spark.createDataFrame([(1, "k")], "community_id long, source_key string")
    records = wall.wall_records(items, sources, F.lit(NOW)).collect()
    assert sorted(r.external_id for r in records) == ["1_8", "1_9"] and json.loads(records[0].metadata)["post_type"] == "post"


def test_fixed_requests_come_in_pages(spark):
    pages = list(fixture.fixture_pages(spark, "k", page_size=5))
    assert [p.items.count() for p in pages] == [5, 5, 3] and [p.more for p in pages] == [True, True, False] and pages[-1].cursor == {"version": 1, "offset": 13}
    rest = list(fixture.fixture_pages(spark, "k", cursor=pages[1].cursor, page_size=5))
    assert [r.external_id for r in rest[0].items.collect()] == ["fixture-v1-11", "fixture-v1-12", "fixture-v1-13"]
    assert [p.items.count() for p in fixture.fixture_pages(spark, "k", "crosspost", since=fixture.FIXTURE_TIME)] == [0]
    assert "fixture-v1-11" in fixture.preview(rest[0]).first()[0]
    for bad in ({"version": 2, "offset": 0}, {"version": 1, "offset": 99}, {"version": 1, "offset": "0"}, {"version": 1, "offset": 0, "dataset": "crosspost"}):
        with pytest.raises(ValueError):
            next(fixture.fixture_pages(spark, "k", cursor=bad))
    with pytest.raises(ValueError):
        next(fixture.fixture_pages(spark, "k", page_size=0))
