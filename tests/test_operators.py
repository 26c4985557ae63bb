import datetime
import itertools
import numbers
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rillflow import registry
from rillflow.operators import delivery
from rillflow.operators.dedup import shared_tokens, signatures, similar_pairs
from rillflow.operators import process
from rillflow.operators import replay
from rillflow.operators.cluster_store import ClusterStore
from rillflow.operators.ranking import distributed_rank
from rillflow.operators.replay import cluster_items, components
from rillflow.sources.fixture import FIXTURE_TIME, TEXTS
from rillflow.sources.records import RAW
from rillflow.sources.wall import decode_windows

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("-" if v is None or v is pd.NA or v != v else str(float(v)) if isinstance(v, numbers.Number) else str(v) for v in r) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_its_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    assert plain(got) == plain(duck.execute(registry.oracle_sql()[name]).df())


def test_similar_pairs_by_brute_force(spark):
    rng = random.Random(1)
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") * 2 + str(rng.randrange(3)) for _ in range(25)] for _ in range(6)]
    sets = []
    for i in range(80):
        words = set(base[i % 6])
        for _ in range(rng.randrange(3)):
            words.add(f"x{rng.randrange(40)}")
        sets.append((i, sorted(words)))
    sets += [(100 + i, sets[i][1]) for i in range(5)] + [(200, ["few"]), (201, [])]
    got = {(r.a, r.b): (r.shared, r.total, r.copies_a, r.copies_b) for r in similar_pairs(spark.createDataFrame(sets, "i long, tokens array<string>"), "i", 90).collect()}
    groups = {}
    for i, words in sets:
        if len(words) >= 5:
            groups.setdefault(tuple(words), []).append(i)
    expected = {}
    for (x, own), (y, other) in itertools.combinations_with_replacement(groups.items(), 2):
        both, either = len(set(x) & set(y)), len(set(x) | set(y))
        if 100 * both >= 90 * either and (x != y or len(own) > 1):
            expected[tuple(sorted((min(own), min(other))))] = (both, either, *((len(own), len(other)) if min(own) <= min(other) else (len(other), len(own))))
    assert got == expected and expected


def single_pass(rows, days=30):
    """All items in one pass, each against every member of every lead, as the rules are stated."""
    leads, rejected, result = [], [], {}
    conflict = lambda a, b: bool(a) and bool(b) and a != b
    time = lambda r: r["published"] or r["at"]
    near = lambda a, b: abs(time(a) - time(b)) <= datetime.timedelta(days=days)

    def unlike(a, b):
        formats = {a["format"], b["format"]} == {"online", "offline"}
        grades = a["grade"] is not None and b["grade"] is not None and a["grade"] != b["grade"]
        return formats or grades or conflict(set(a["goals"]), set(b["goals"])) or conflict((a["location"] or "").lower(), (b["location"] or "").lower()) or conflict(a["budget"], b["budget"])

    def put(lead, r, method, s):
        lead["members"].append(r)
        result[r["item_id"]] = (lead["id"], method, round(s, 2))

    for r in sorted(rows, key=lambda r: (r["at"], r["item_id"])):
        words = set(r["tokens"])
        anchors = sorted(words, key=lambda t: (-len(t), t))[:3]
        found = None
        if r["url"]:
            found = next(((x, "exact_url", 100.0) for x in leads if any(m["url"] == r["url"] for m in x["members"])), None)
        if not found and anchors:
            best = None
            for x in leads:
                for m in sorted(x["members"], key=lambda m: m["item_id"]):
                    same = m["fingerprint"] == r["fingerprint"]
                    if x["face"]["kind"] != r["kind"] or not near(m, r) or conflict(set(m["contacts"]), set(r["contacts"])) or unlike(r, x["face"]) or not (same or any(a in m["readable"].lower() for a in anchors)):
                        continue
                    if same:
                        found = found or (x, "exact_text", 100.0)
                        continue
                    other = set(m["tokens"])
                    s = 100 * len(words & other) / len(words | other)
                    if min(len(words), len(other)) >= 5 and s >= 90 and (best is None or s > best[2]):
                        best = (x, "fuzzy_text", s)
            found = found or best
        if not found and not r["eligible"]:
            rejected.append(r)
            result[r["item_id"]] = (None, None, None)
            continue
        if not found:
            leads.append({"id": r["item_id"], "members": [], "face": r})
            found = (leads[-1], "exact_id", 100.0)
        lead = found[0]
        put(lead, r, *found[1:])
        if r["eligible"]:
            rank = lambda i: (i["score"], i["completeness"], -i["item_id"])
            if rank(r) > rank(lead["face"]):
                lead["face"] = r
            for e in sorted(rejected, key=lambda e: e["item_id"]):
                url = bool(r["url"]) and e["url"] == r["url"]
                if url or e["fingerprint"] == r["fingerprint"] and near(e, r) and e["kind"] == r["kind"] and not conflict(set(e["contacts"]), set(r["contacts"])) and not unlike(r, e):
                    put(lead, e, "exact_url" if url else "exact_text", 100.0)
                    rejected = [x for x in rejected if x is not e]
    return {i: (c, m, s, next(x["face"]["item_id"] for x in leads if x["id"] == c) if c is not None else None) for i, (c, m, s) in result.items()}


ITEM = "item_id long, at timestamp, published timestamp, url string, kind string, fingerprint string, tokens array<string>, readable string, contacts array<string>, eligible boolean, score int, completeness int, grade int, goals array<string>, format string, location string, budget string"


def some_items(seed, n=150):
    rng, start = random.Random(seed), datetime.datetime(2026, 1, 1)
    rows = []
    for i in range(n):
        k = rng.randrange(6)
        words = [f"w{k}x{j}" for j in range(22)]
        if rng.random() < 0.5:
            words[rng.randrange(22)] = f"v{rng.randrange(3)}"
        if rng.random() < 0.1:
            words = words[:4]
        order = sorted(set(words), reverse=rng.random() < 0.3)
        pick = lambda *values, p=0.2: rng.choice(values) if rng.random() < p else None
        rows.append({
            "item_id": i, "at": start + datetime.timedelta(hours=rng.randrange(2000)), "published": start + datetime.timedelta(days=rng.randrange(90)) if rng.random() < 0.5 else None, "url": pick("u1", "u2", "u3", p=0.15), "kind": rng.choice("aab"),
            "fingerprint": " ".join(order), "tokens": sorted(set(words)), "readable": " ".join(order).upper(), "contacts": pick(["1"], ["2"]) or [], "eligible": rng.random() < 0.7, "score": rng.randrange(5), "completeness": rng.randrange(3),
            "grade": pick(9, 10), "goals": pick(["x", "y"], ["y", "x"], ["z"]) or [], "format": pick("online", "offline", "either") or "unknown", "location": pick("Пермь", "пермь", "Омск"), "budget": pick("1", "2"),
        })
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_clusters_are_those_of_a_single_pass(spark, seed):
    rows = some_items(seed)
    frame = spark.createDataFrame([tuple(r[c.split()[0]] for c in ITEM.split(", ")) for r in rows], ITEM)
    got = {r.item_id: (r.cluster_id, r.method, r.similarity, r.canonical_id) for r in cluster_items(frame).collect()}
    expected = single_pass(rows)
    assert got == expected
    assert {m for _, m, _, _ in expected.values()} == {None, "exact_id", "exact_text", "exact_url", "fuzzy_text"}


@pytest.mark.parametrize("seed", [4])
def test_slices_of_a_component_carry_what_is_needed(spark, seed):
    rows = some_items(seed)
    frame = spark.createDataFrame([tuple(r[c.split()[0]] for c in ITEM.split(", ")) for r in rows], ITEM)
    got = {r.item_id: (r.cluster_id, r.method, r.similarity, r.canonical_id) for r in cluster_items(frame, slice_rows=30).collect()}
    assert got == single_pass(rows)


def test_copies_of_a_cluster_are_carried_once(spark):
    """A third of all items is one text: what goes from slice to slice doesn't grow with it."""
    start = datetime.datetime(2026, 1, 1)
    words = [f"w{i}" for i in range(8)]
    rows = [{"item_id": i, "at": start + datetime.timedelta(minutes=i), "published": None, "url": None, "kind": "a", "fingerprint": "t", "tokens": words, "readable": "w0", "contacts": [], "eligible": True, "score": 1, "completeness": 1, "grade": None, "goals": [], "format": None, "location": None, "budget": None} for i in range(600)]
    rows = [replay.OPTIONAL | r | {"component": 0, "set_id": 0, "known_cluster": 0, "known_face": r["item_id"] == 0, "known_created": start, "waiting": False} for r in rows]
    state = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} {replay.OPTIONAL.get(c) or dict(x.split(' ', 1) for x in ITEM.split(', ')).get(c, 'long')}" for c in rows[0]))
    later = spark.createDataFrame([(0, 1767225600.0, 1768225600.0)], "component long, lo double, hi double")
    urls = spark.createDataFrame([], "component long, url string")
    assert replay.carried(state, later, urls, 30).count() <= 3


def test_texts_link_within_the_window_alone(spark):
    at = [datetime.datetime(2026, 1, 1) + datetime.timedelta(days=d) for d in (0, 29, 58, 100, 140, 169)]
    rows = [dict(some_items(1, 1)[0], item_id=i, at=t, published=None, url=None, fingerprint="t", tokens=["a", "b"]) for i, t in enumerate(at)]
    frame = spark.createDataFrame([tuple(r[c.split()[0]] for c in ITEM.split(", ")) for r in rows], ITEM)
    items, pairs = replay.prepared(frame, 90)
    edges = replay.link_edges(items, pairs, 30)
    got = {r.node: r.component for r in components(edges, items.selectExpr("item_id AS node")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4}


def test_ranks_of_large_groups(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, None]), i, rng.random()) for i in range(3000)]
    frame = spark.createDataFrame(rows, "g long, i long, x double")
    got = {r.i: r.rank for r in distributed_rank(frame, "g", [F.col("x").desc(), F.col("i")]).collect()}
    for g in (1, 2, None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        assert [got[r[1]] for r in own] == list(range(1, len(own) + 1))


def test_members_of_earlier_leads_stay_theirs(spark):
    rows = some_items(4, 40)
    frame = lambda rows, **more: spark.createDataFrame([tuple({**r, **more}[c.split()[0]] for c in ITEM.split(", ")) for r in rows], ITEM)
    rows = [r | {"at": r["at"].replace(year=2026 if r["item_id"] < 30 else 2027), "published": r["published"] or r["at"]} for r in rows]
    first = {r.item_id: r for r in cluster_items(frame(rows[:30])).collect()}
    known = spark.createDataFrame([(i, r.cluster_id, i == r.canonical_id) for i, r in first.items() if r.cluster_id is not None], "item_id long, known_cluster long, known_face boolean")
    # What was rejected then is rejected now: it is left out of the second run.
    kept = [r for r in rows if first.get(r["item_id"]) is None or first[r["item_id"]].cluster_id is not None]
    second = {r.item_id: r.cluster_id for r in cluster_items(frame(kept).join(known, "item_id", "left")).collect()}
    assert all(second[i] == r.cluster_id for i, r in first.items() if r.cluster_id is not None)
    whole = single_pass(kept)
    assert {i: c for i, c in second.items() if i >= 30 and c is not None and c < 30}.keys() <= {r["item_id"] for r in rows} and len(second) == len(kept) and whole


@pytest.mark.parametrize(
    "change, leads, method",
    [
        ({"url": "https://example.invalid/request?utm_source=b&id=1", "text": "Нужен репетитор по литературе, 9 класс, ОГЭ, онлайн. Бюджет до 2000 руб за час."}, 1, "exact_url"),
        ({"upper": True}, 1, "exact_text"),
        ({"end": " Пожалуйста."}, 1, "fuzzy_text"),
        ({"grade": True}, 2, None),
        ({"published": 31}, 2, None),
        ({"published": 30}, 1, "exact_text"),
        ({"end": " Только опытный преподаватель с подтвержденными результатами и рекомендациями."}, 2, None),
        ({"phones": True}, 2, None),
    ],
)
def test_variants_of_one_request(spark, change, leads, method):
    text, at = TEXTS["primary"][-1], FIXTURE_TIME
    other = change.get("text", text).replace("10 класс", "9 класс" if change.get("grade") else "10 класс") + change.get("end", "")
    other = other.upper() if change.get("upper") else other
    numbers = (" +7 (999) 123-45-67", " +7 (999) 765-43-21") if change.get("phones") else ("", "")
    rows = [
        (1, "a", "https://example.invalid/request?id=1&utm_source=a", at, at, text + numbers[0], "{}"),
        (2, "b", change.get("url", "https://example.invalid/another"), at + datetime.timedelta(days=change.get("published", 0)), at + datetime.timedelta(seconds=1), other + numbers[1], "{}"),
    ]
    items = process.process(spark.createDataFrame(rows, "item_id long, " + RAW.replace("external_id string, ", "")), F.lit("2026-01-01 13:00:00").cast("timestamp"))
    got = {r.item_id: r for r in process.cluster(items).collect()}
    assert len({r.cluster_id for r in got.values()}) == leads and all(r.cluster_id is not None for r in got.values())
    assert method is None or got[2].method == method


def test_pending_items_and_bad_arguments(spark):
    rows = [(i, "s", None, None, FIXTURE_TIME, None if i == 2 else "Ищу репетитора по литературе", "{}", "pending") for i in range(4)]
    items = spark.createDataFrame(rows, "item_id long, " + RAW.replace("external_id string, ", "") + ", processing_status string")
    now = F.lit("2026-01-01").cast("timestamp")
    done, failed = process.process_pending(items, now, limit=3)
    assert sorted(r.item_id for r in done.collect()) == [0, 1] and [(r.item_id, r.processing_error) for r in failed.collect()] == [(2, "missing_text")]
    with pytest.raises(ValueError):
        process.process_pending(items, now, limit=0)
    with pytest.raises(ValueError):
        process.process(items.withColumn("collected_at", F.col("collected_at").cast("timestamp_ntz")), now)
    clusters = process.cluster(done)
    sources = spark.createDataFrame([("s", "Source")], "source_key string, display_name string")
    found = process.leads(clusters, done)
    view = process.lead_views(found, done, sources).first()
    assert view.lead.source == "Source" and view.lead.reason_ids[:2] == ["seeking_tutor", "literature"] and found.first().occurrences == 2
    members = process.known_members(found, process.occurrences(clusters), done)
    assert sorted((r.item_id, r.known_cluster, r.known_face) for r in members.collect()) == [(0, 0, True), (1, 0, False)]


def test_a_long_chain_is_one_component(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    nodes = spark.range(203).select(F.col("id").alias("node"))
    got = {r.node: r.component for r in components(edges, nodes).collect()}
    assert got == {n: 0 if n <= 200 else n for n in range(203)}
    with pytest.raises(RuntimeError):
        components(edges, nodes, rounds=1)


def test_chunks_and_delivery():
    cards = pd.DataFrame({"conv_id": [1, 1, 1], "turn": [0, 1, 2], "text": ["a" * 6, "b" * 5, None]})
    assert delivery.pack_cards(cards, 10).chunk.tolist() == [0, 1, 1]
    chunks = pd.DataFrame({"conv_id": [1, 1], "turn": [0, 1], "outcomes": [["retryable", "ok"], ["ambiguous", "ok"]]})
    assert delivery.deliver_envelope(chunks).values.tolist() == [[1, 1, 3, "ambiguous"]]


def test_unsound_windows_give_nothing(spark):
    post = '{"id":%d,"owner_id":-1,"date":1,"text":"t","post_type":"post"}'
    good = '{"response":{"count":2,"items":[%s,%s]}}' % (post % 5, post % 3)
    bad = '{"response":{"count":2,"items":[%s,%s]}}' % (post % 3, post % 5)
    rows = spark.createDataFrame([("g", 1, good), ("b", 1, bad), ("x", 1, "nonsense")], "window_id string, community_id long, payload string")
    assert sorted((r.window_id, r.post_id) for r in decode_windows(rows).collect()) == [("g", 3), ("g", 5)]


@pytest.mark.parametrize("seed, batches", [(5, 2)])
def test_batches_make_the_clusters_of_one_run(spark, tmp_path, seed, batches):
    rows = sorted(some_items(seed), key=lambda r: (r["at"], r["item_id"]))
    frame = lambda rows: spark.createDataFrame([tuple(r[c.split()[0]] for c in ITEM.split(", ")) for r in rows], ITEM)
    store, size = ClusterStore(spark, str(tmp_path), slice_rows=40), -(-len(rows) // batches)
    changed = {}
    for i in range(0, len(rows), size):
        again = rows[max(0, i - 5) : i]  # what an earlier batch held is no news
        changed |= {r.item_id: r.cluster_id for r in store.add(frame(again + rows[i : i + size])).collect()}
    got = {r.item_id: (r.cluster_id, r.method, r.similarity, r.canonical_id) for r in store.clusters().collect()}
    expected = single_pass(rows)
    assert got == expected and changed == {i: x[0] for i, x in expected.items()}


def test_a_batch_reads_what_it_may_touch(spark, tmp_path):
    """After a year of batches, one more reads the bands and buckets of its own items; an unfinished batch counts for nothing."""
    start = datetime.datetime(2026, 1, 1)
    rows = [dict(r, at=start + datetime.timedelta(days=i), published=None, url=f"u{i}", item_id=i) for i, r in enumerate(some_items(3, 360))]
    frame = lambda rows: spark.createDataFrame([tuple(r[c.split()[0]] for c in ITEM.split(", ")) for r in rows], ITEM)
    store = ClusterStore(spark, str(tmp_path))
    store.add(frame(rows[:350]))
    store.add(frame(rows[350:]))
    held = store.clusters().where("item_id < 90 AND cluster_id IS NOT NULL").orderBy("item_id").first()
    last = dict(rows[-1], item_id=1000, at=start + datetime.timedelta(days=361), url=f"u{held.item_id}")
    store.spark.read.parquet(f"{tmp_path}/members").limit(3).drop("batch", "band").withColumn("band", F.lit(12)).write.partitionBy("band").parquet(f"{tmp_path}/members/batch=3")
    changed = {r.item_id: r for r in store.add(frame([last])).collect()}
    assert (changed[1000].method, changed[1000].cluster_id) == ("exact_url", held.cluster_id)
    assert store._table("members").where("batch = 3").count() == len(changed)
    # Bands of 30 days: 361 days are 13 bands, of which three are read, and one for the URL.
    read = store.rows_read()
    assert 0 < read["members"] <= 4 * 30 and read["urls"] <= 30 and read["clusters"] <= 120 and read["postings"] <= 3 * 30 * 6


def test_candidates_of_similar_sets_are_not_all_that_share_a_word(spark):
    """Sets of 20 words out of 60 share frequent words, and few are alike: candidates follow the links."""
    rng = random.Random(4)
    sets = [[f"w{k}" for k in rng.sample(range(60), rng.choice((19, 20, 21, 22, 23)))] for _ in range(300)]
    for i in range(0, 300, 3):
        sets.append(sets[i] + ["more"] if i % 2 else sets[i][1:])
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "i long, tokens array<string>")
    got = {(r.a, r.b) for r in similar_pairs(frame, "i", 90).collect()}
    assert got == {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 100 * len(set(sets[i]) & set(sets[j])) >= 90 * len(set(sets[i]) | set(sets[j]))} and len(got) >= 100
    hashed = [(i, len(s), sorted(rng.getrandbits(63) for _ in s)) for i, s in enumerate(sets)]
    dealt = spark.createDataFrame(hashed, "k1 long, n int, hashes array<long>").mapInArrow(signatures(90), "k1 long, n int, home boolean, place long, part long")
    # A set of 20 differs in at most two words from one of 19 to 22, or in one of 19 and two of 21: three to five places.
    assert dealt.where("home").groupBy("k1").count().agg({"count": "max"}).first()[0] <= 5


def test_components_are_replayed_in_few_groups(spark):
    """A group holds many components, and what it finds for one doesn't touch another."""
    import inspect

    assert "groupBy(\"component\")" not in inspect.getsource(replay.step)
    item = {"at": pd.Timestamp("2026-01-01"), "published": None, "url": None, "kind": "a", "tokens": ["t"], "contacts": [], "eligible": True, "readable": None, "score": 1, "completeness": 1, "grade": None, "goals": [], "format": None, "location": None, "budget": None, "known_cluster": None, "known_face": None, "known_created": None, "waiting": None, "set_id": None}
    rows = pd.DataFrame([item | {"item_id": i, "component": i // 2 * 2, "fingerprint": "same"} for i in range(6)])
    found = replay.replay(rows, pd.DataFrame({"part": [], "x": [], "y": [], "similarity": []}))
    assert dict(zip(found.item_id, found.cluster_id)) == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4}


def test_shared_tokens_are_counted_in_blocks(spark):
    rng = random.Random(3)
    sets = {i: sorted(rng.sample(range(-60, 60), rng.randint(1, 40))) for i in range(40)}
    # A group of many pairs, a star, a chain, and a pair of its own.
    pairs = {*itertools.combinations(range(12), 2), *((12, i) for i in range(13, 25)), *((i, i + 1) for i in range(25, 36)), (38, 39)}
    rows = spark.createDataFrame([(i, len(s), s) for i, s in sets.items()], "id long, n int, hashes array<long>")
    frame = spark.createDataFrame(sorted(pairs), "x long, y long")
    want = sorted((x, y, len({*sets[x]} & {*sets[y]}), len(sets[x]) + len(sets[y])) for x, y in pairs)
    for settings in ({}, {"block_tokens": 60, "block_sets": 3}, {"broadcast_ids": 0}):
        assert sorted(map(tuple, shared_tokens(frame, rows, **settings).collect())) == want
    assert shared_tokens(frame.limit(0), rows).count() == 0
