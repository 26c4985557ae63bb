"""Windows of a social wall, as JSON: all posts of a sound window, none of another."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bounds of a window.
LARGEST_WINDOW, LONGEST_TEXT, MOST_REPOSTS, DEEPEST_REPOST = 2 << 20, 65_536, 5, 3
KINDS = ("post", "copy")
POST = "post_id:bigint,date:bigint,text:string,pinned:boolean,post_type:string,originals:array<struct<owner_id:bigint,post_id:bigint>>"
DECODED = f"failure string, code int, posts array<struct<{POST}>>"


class Unsound(ValueError):
    """A window that can't be trusted; its reason is the message."""


def need(held: bool, reason: str = "malformed_response") -> None:
    if not held:
        raise Unsound(reason)


def whole(value, least: int = 1) -> int:
    """A 64-bit integer of at least `least`; booleans and floats are none."""
    need(type(value) is int and least <= value < 1 << 63)
    return value


def said(value, bounded: bool = True) -> str:
    need(isinstance(value, str) and not (bounded and "\0" in value))
    try:
        value.encode()
    except UnicodeEncodeError:
        raise Unsound("malformed_response") from None
    need(not bounded or len(value) <= LONGEST_TEXT, "response_too_large")
    return value


def strict_json(payload: str):
    """JSON whose objects name each key once and whose numbers are finite."""

    def once(pairs):
        need(len({k for k, _ in pairs}) == len(pairs))
        return dict(pairs)

    def finite(_):
        raise Unsound("malformed_response")

    try:
        return json.loads(payload, object_pairs_hook=once, parse_constant=finite)
    except (json.JSONDecodeError, RecursionError):
        raise Unsound("malformed_response") from None


def quoted(history, level: int = 0, bounded: bool = True) -> list[tuple[int, int, str]]:
    """(owner, post, text) of the posts that a post repeats, and of those they repeat, level by level down."""
    need(isinstance(history, list) and len(history) <= MOST_REPOSTS and (not history or level < DEEPEST_REPOST))
    out: list[tuple[int, int, str]] = []
    for original in history:
        need(isinstance(original, dict) and original.get("owner_id") != 0)
        out += [(whole(original.get("owner_id"), 1 - (1 << 63)), whole(original.get("id")), said(original.get("text"), bounded)), *quoted(original.get("copy_history", []), level + 1, bounded)]
    need(len(out) <= MOST_REPOSTS)
    return out


def read_post(item, community: int, bounded: bool = True) -> dict:
    """A post with its own text and that of its distinct originals, a blank line between."""
    need(isinstance(item, dict) and item.get("owner_id") == -community and type(item["owner_id"]) is int)
    pin, originals = item.get("is_pinned", 0), quoted(item.get("copy_history", []), bounded=bounded)
    need(type(pin) is int and pin in (0, 1) and item.get("post_type") in KINDS)
    texts = dict.fromkeys([said(item.get("text"), bounded), *(text for _, _, text in originals)])
    text = "\n\n".join(t for t in texts if t)
    need(not bounded or len(text) <= LONGEST_TEXT, "response_too_large")
    links = [{"owner_id": owner, "post_id": post} for owner, post, _ in originals]
    return {"post_id": whole(item.get("id")), "date": whole(item.get("date"), 0), "text": text, "pinned": pin == 1, "post_type": item["post_type"], "originals": links}


def read_window(payload: str | None, community: int, limit: int | None, bounded: bool = True) -> dict:
    """The posts of a sound window, or why there are none; an error of the provider has its code."""
    try:
        need(payload is not None)
        need(not bounded or len(payload.encode()) <= LARGEST_WINDOW, "response_too_large")
        envelope = strict_json(payload)
        need(isinstance(envelope, dict) and ("error" in envelope) != ("response" in envelope))
        answer = envelope.get("response", envelope.get("error"))
        need(isinstance(answer, dict))
        if "error" in envelope:
            return {"failure": "error", "code": whole(answer.get("error_code")), "posts": []}
        items, count = answer.get("items"), whole(answer.get("count"), 0)
        # A window shorter than it could be can't prove that it shows all there is.
        need(isinstance(items, list) and (len(items) <= count if limit is None else len(items) == min(count, limit)))
        posts = [read_post(item, community, bounded) for item in items]
        ids, loose = [p["post_id"] for p in posts], [p["post_id"] for p in posts if not p["pinned"]]
        need(len(set(ids)) == len(ids) and len(ids) - len(loose) <= 1 and all(a > b for a, b in zip(loose, loose[1:])))
        return {"failure": None, "code": None, "posts": posts}
    except Unsound as reason:
        return {"failure": str(reason), "code": None, "posts": []}


def decode(windows: DataFrame, limit: int | None = None, bounded: bool = True) -> DataFrame:
    """`windows` (window_id, community_id, payload) with failure, code and posts.

    A window has either a response or an error. A sound response has posts of
    its community, with distinct ids, of known kinds, one of them pinned at most
    and the ids of the others falling, as many as it counts up to `limit` (null:
    no more than it counts). Otherwise all of it is refused: JSON with repeated
    keys or non-finite numbers, texts or reposts beyond their bounds. A community
    is named by the number whose negative owns its posts. Windows that no provider
    sent need not be `bounded`: then their texts and they themselves may be of any
    size and hold NUL.
    """

    @F.pandas_udf(DECODED)
    def read(payloads: pd.Series, communities: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_window(p, int(c), limit, bounded) for p, c in zip(payloads, communities)], columns=["failure", "code", "posts"]).astype({"code": "Int32"})

    return windows.withColumn("d", read("payload", "community_id")).select(*windows.columns, "d.*")


def decode_windows(windows: DataFrame, limit: int | None = None, bounded: bool = True) -> DataFrame:
    """(window_id, post_id, date, text, pinned) of the posts of sound windows; see `decode`."""
    posts = decode(windows, limit, bounded).select("window_id", F.explode("posts").alias("p"))
    return posts.select("window_id", "p.post_id", "p.date", "p.text", "p.pinned")


def new_posts(posts: DataFrame, mark: int) -> DataFrame:
    """The posts above a mark, the newest first."""
    return posts.where(F.col("post_id") > mark).orderBy(F.desc("post_id"))


def read_on(decoded: DataFrame, cursors: DataFrame, initial: int, incremental: int) -> tuple[DataFrame, DataFrame]:
    """(items, marks) of decoded windows (window_id, community_id, failure, posts), one of each community, and `cursors` (community_id, mark; null or none: never read).

    Items are the posts above the mark. A mark becomes the largest id seen; zero
    is that of an empty wall. A full window whose loose posts are all above the
    mark may have left some out: it gives no items, keeps its mark and fails with
    `overflow`. The first window of a community has no such bound. How many posts
    fill a window depends on whether it is the first one: `initial`, `incremental`.
    """
    known = decoded.join(cursors.select("community_id", F.col("mark").alias("old")), "community_id", "left")
    full = F.size("posts") == F.when(F.col("old").isNull(), initial).otherwise(incremental)
    bounded = F.exists("posts", lambda p: ~p["pinned"] & (p["post_id"] <= F.col("old")))
    failure = F.when(F.col("failure").isNotNull(), F.col("failure")).when(F.col("old").isNotNull() & full & ~bounded, "cursor_overflow")
    judged = known.select("window_id", "community_id", "old", failure.alias("failure"), F.when(failure.isNull(), F.filter("posts", lambda p: p["post_id"] > F.coalesce("old", F.lit(0)))).otherwise(F.array().cast(f"array<struct<{POST}>>")).alias("posts"))
    items = judged.select("community_id", F.explode("posts").alias("p")).select("community_id", "p.*")
    mark = F.when(F.col("failure").isNull(), F.greatest(F.coalesce("old", F.lit(0)), F.coalesce(F.array_max(F.transform("posts", lambda p: p["post_id"])), F.lit(0)))).otherwise(F.col("old"))
    return items, judged.select("community_id", mark.alias("mark"), "failure")


def wall_records(items: DataFrame, sources: DataFrame, collected_at: Column) -> DataFrame:
    """Items of `read_on` as records; `sources`: community_id, source_key."""
    key = F.concat_ws("_", "community_id", "post_id")
    said_by = F.to_json(F.struct("community_id", "post_id", F.col("pinned").alias("is_pinned"), "post_type", F.lit("wall_post").alias("evidence_kind"), "originals"))
    return items.join(sources, "community_id").select("source_key", key.alias("external_id"), F.timestamp_seconds("date").alias("published_at"), collected_at.alias("collected_at"), "text", said_by.alias("metadata"))


def sample_windows(documents: DataFrame) -> DataFrame:
    """Documents as windows of one community a source, the newest first, whatever their texts' sizes; a document without a text is a post without one."""
    post = F.struct((F.col("doc_id") + 1).alias("id"), F.lit(-1).cast("long").alias("owner_id"), (F.col("doc_id") * 60).alias("date"), F.coalesce("text", F.lit("")).alias("text"), F.lit("post").alias("post_type"))
    day = F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 500).cast("string"))
    windows = documents.groupBy(day.alias("window_id")).agg(F.sort_array(F.collect_list(post), asc=False).alias("items"))
    return windows.select("window_id", F.lit(1).cast("long").alias("community_id"), F.to_json(F.struct(F.struct(F.size("items").alias("count"), "items").alias("response"))).alias("payload"))
