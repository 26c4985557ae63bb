"""Collection runs over a provider's pages: failures, restarts and pauses."""

import json

import pytest
from pyspark.sql import functions as F

from rillflow.sources.pages import PageReader
from rillflow.streaming.collect import Collection


def provider(path, pages):
    """Pages as {source: [[ids] or (failure, wait)]}."""
    for source, own in pages.items():
        for number, page in enumerate(own):
            folder = path / f"source_key={source}" / f"page={number}"
            folder.mkdir(parents=True)
            rows = [{"failure": page[0], "retry_after": page[1]}] if isinstance(page, tuple) else [{"external_id": i, "published_s": 1000 + 10 * number, "text": str(i)} for i in page]
            (folder / "part-0.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def at(seconds):
    return F.timestamp_seconds(F.lit(seconds))


def found(store):
    return {(r.source_key, r.external_id): r.run_id for r in store.items().collect()}


def rows(frame):
    return {r.source_key: (r.status, r.items_seen, r.items_inserted, r.items_failed, r.error_category) for r in frame.collect()}


def state(store):
    return {r.source_key: (r.cursor, r.failures, r.mark) for r in store.states().select("source_key", "cursor", "failures", F.unix_timestamp("high_water_mark").alias("mark")).collect()}


def test_runs_go_on_from_their_cursors(spark, tmp_path):
    sources = spark.createDataFrame([("a", "search"), ("b", "search"), ("c", "wall")], "source_key string, kind string")
    store = Collection(spark, str(tmp_path / "store"))
    first = provider(tmp_path / "p1", {"a": [["1", "2"], ["2", "3"], []], "b": [["1"], ("provider_server", 100), ["9"]], "c": [["x"], ["y", None], ["z"]]})
    assert rows(store.run(first, sources, at(5000))) == {"a": ("succeeded", 4, 3, 0, None), "b": ("partial", 1, 1, 0, "provider_server"), "c": ("partial", 4, 3, 1, "invalid_record")}
    # A failed page stops the cursor; so does an invalid item, though what comes after it is kept.
    assert state(store) == {"a": (3, 0, 1010), "b": (1, 1, 1000), "c": (1, 1, 1000)}
    assert set(found(store)) == {("a", "1"), ("a", "2"), ("a", "3"), ("b", "1"), ("c", "x"), ("c", "y"), ("c", "z")}
    second = provider(tmp_path / "p2", {"a": [["1", "2"], ["2", "3"], [], ["4"]], "b": [["1"], ["5"], ["9"]], "c": [["x"], ["y", "w"], ["z"]]})
    # A source that asked to wait isn't read before its time.
    assert rows(store.run(second, sources, at(5050))) == {"a": ("succeeded", 1, 1, 0, None), "c": ("succeeded", 3, 1, 0, None)}
    assert rows(store.run(second, sources, at(5200))) == {"a": ("succeeded", 0, 0, 0, None), "b": ("succeeded", 2, 2, 0, None), "c": ("succeeded", 0, 0, 0, None)}
    assert state(store) == {"a": (4, 0, 1030), "b": (3, 0, 1020), "c": (3, 0, 1020)}
    assert found(store) == {("a", "1"): 1, ("a", "2"): 1, ("a", "3"): 1, ("a", "4"): 2, ("b", "1"): 1, ("b", "5"): 3, ("b", "9"): 3, ("c", "x"): 1, ("c", "y"): 1, ("c", "z"): 1, ("c", "w"): 2}


def test_a_run_that_broke_off_is_made_good(spark, tmp_path):
    sources = spark.createDataFrame([("a", "search")], "source_key string, kind string")
    folder = provider(tmp_path / "p", {"a": [["1", "2"], ["3"]]})
    store = Collection(spark, str(tmp_path / "store"))

    def broken(number, epoch):
        raise OSError("lost")

    with pytest.raises(Exception, match="lost"):
        store.run(folder, sources, at(5000), broken)
    assert store.states().count() == 0 and len(found(store)) == 3
    assert rows(store.run(folder, sources, at(6000))) == {"a": ("succeeded", 3, 0, 0, None)}
    assert {(r.run_id, r.status, r.error_category) for r in store.runs().collect()} == {(1, "failed", "interrupted"), (2, "succeeded", None)}
    assert state(store) == {"a": (2, 0, 1010)} and store.items().count() == 3


def test_a_wall_whose_first_window_was_lost_is_refused(spark, tmp_path):
    sources = spark.createDataFrame([("w", "wall")], "source_key string, kind string")
    store = Collection(spark, str(tmp_path / "store"))
    store.run(provider(tmp_path / "p1", {"w": [["1", None]]}), sources, at(5000))
    assert rows(store.run(provider(tmp_path / "p2", {"w": [["1", "2"]]}), sources, at(6000))) == {"w": ("failed", 0, 0, 0, "cursor_overflow")}


def test_offsets_and_tasks(tmp_path):
    reader = PageReader(provider(tmp_path / "p", {"a b": [["1"]] * 5, "c": []}), {"a b": 1, "c": 0, "new": 0}, 3)
    assert reader.initialOffset() == {"a b": 1, "c": 0, "new": 0} and reader.latestOffset() == {"a b": 5, "c": 0, "new": 0}
    tasks = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert [(t.source, t.first, t.end) for t in tasks] == [("a b", 1, 4), ("a b", 4, 5)]
    assert [r[1:4] for r in reader.read(tasks[1])] == [(4, 1, "1"), (4, 0, None)]
