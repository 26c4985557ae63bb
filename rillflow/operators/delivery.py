"""Message packing and the delivery state machine, folded per envelope.

An envelope is one message to one person; its chunks are sent in order. Both
folds see one envelope's rows at a time, which its size bounds.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.functions import outcomes
from rillflow.functions import presentation as P

CHUNK_LIMIT, BUTTON_LIMIT, MAX_ATTEMPTS = 3800, 80, 3
RETRYABLE = ("retryable", "rate_limited")
ACTIVE = ("new", "notified", "interested")
DELIVERED = "conv_id long, sent long, attempts long, status string"
MESSAGES = "envelope_id long, position int, body string, n_cards int, n_buttons int, units int"


def pack_cards(rows: pd.DataFrame, limit: int = CHUNK_LIMIT) -> pd.DataFrame:
    """Cards of one envelope in order, as few chunks as greedy packing gives; a card alone may be longer."""
    chunk, size, out = 0, 0, []
    for r in rows.sort_values("turn").itertuples(index=False):
        units = P.units(r.text or "")
        if size and size + units > limit:
            chunk, size = chunk + 1, 0
        size += units
        out.append((r.conv_id, r.turn, chunk, units))
    return pd.DataFrame(out, columns=["conv_id", "turn", "chunk", "units"])


def pack(cards: DataFrame, limit: int = CHUNK_LIMIT) -> DataFrame:
    return cards.select("conv_id", "turn", "text").groupBy("conv_id").applyInPandas(lambda rows: pack_cards(rows, limit), "conv_id long, turn long, chunk long, units long")


def digest_messages(rows: pd.DataFrame, limit: int = CHUNK_LIMIT, most_buttons: int = BUTTON_LIMIT, per_card: int = len(P.ACTION_LABELS)) -> pd.DataFrame:
    """The messages of one digest: a head and numbered cards, each card whole.

    A message is closed before a card that would make it too long, or once it
    has `most_buttons` buttons. `rows`: envelope_id, header, rank, card; a
    digest without cards (card null) is its head alone.
    """
    rows = rows.sort_values("rank")
    body, cards, out = P.safe(rows.header.iloc[0], 600), 0, []

    def close():
        out.append((rows.envelope_id.iloc[0], len(out), body, cards, cards * per_card, P.units(body)))

    for number, text in enumerate(rows.card.dropna(), 1):
        block = f"\n\n<b>Заявка {number}</b>\n{text}"
        if P.units(body) + P.units(block) > limit or cards * per_card >= most_buttons:
            close()
            body, cards = P.CONTINUED, 0
        body, cards = body + block, cards + 1
    close()
    return pd.DataFrame(out, columns=["envelope_id", "position", "body", "n_cards", "n_buttons", "units"])


def compose_digests(cards: DataFrame, limit: int = CHUNK_LIMIT, most_buttons: int = BUTTON_LIMIT) -> DataFrame:
    """The messages of every digest of `cards` (envelope_id, header, rank, card)."""
    return cards.select("envelope_id", "header", "rank", "card").groupBy("envelope_id").applyInPandas(lambda rows: digest_messages(rows, limit, most_buttons), MESSAGES)


def deliver_envelope(rows: pd.DataFrame) -> pd.DataFrame:
    """The end state of one envelope: chunks go in order, each until it is sent, stuck or out of attempts.

    `outcomes` of a chunk are the results of its attempts in order: ok,
    retryable, rate_limited, permanent or ambiguous. A chunk that isn't sent
    stops those after it; an ambiguous one is never sent again.
    """
    sent, attempts, status = 0, 0, "sent"
    for r in rows.sort_values("turn").itertuples(index=False):
        state = "pending"
        for outcome in list(r.outcomes)[:MAX_ATTEMPTS]:
            attempts += 1
            state = "sent" if outcome == "ok" else outcome
            if outcome not in RETRYABLE:
                break
        if state != "sent":
            status = "ambiguous" if state == "ambiguous" else "failed"
            break
        sent += 1
    return pd.DataFrame([(rows.conv_id.iloc[0], sent, attempts, status)], columns=["conv_id", "sent", "attempts", "status"])


def deliver(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("conv_id").applyInPandas(deliver_envelope, DELIVERED)


def claim(envelopes: DataFrame, chunks: DataFrame, now: Column) -> DataFrame:
    """(envelope_id, action, position): what may happen to each envelope now.

    `envelopes`: envelope_id, status, lead_status (null: a digest), lead_missing,
    paused, explicit. `chunks`: envelope_id, position, status, last_error,
    attempts, next_attempt_at. Actions: none (over, paused, not due or stuck),
    skip (its lead isn't active), sent and missing (no chunk is left, or there
    never was one), ambiguous (a send was broken off: never send it twice), send.
    """
    # The first chunk that isn't sent decides; its fields travel with the least position.
    state = chunks.groupBy("envelope_id").agg(
        F.min(F.when(F.col("status") != "sent", F.struct("position", "status", "last_error", "attempts", "next_attempt_at"))).alias("next")
    )
    joined = envelopes.join(state.withColumn("any", F.lit(True)), "envelope_id", "left")
    next_ = F.col("next")
    inactive = F.col("lead_missing") | ~F.coalesce(F.col("lead_status").isin(*ACTIVE), F.lit(True))
    stuck = (
        (next_["status"] == "ambiguous")
        | (next_["attempts"] >= MAX_ATTEMPTS)
        | ((next_["status"] == "failed") & ~F.coalesce(next_["last_error"].isin(*RETRYABLE), F.lit(False)))
        | F.coalesce(next_["next_attempt_at"] > now, F.lit(False))
    )
    action = (
        F.when(F.col("status").isin("sent", "skipped") | (F.col("paused") & ~F.col("explicit")), "none")
        .when(inactive, "skip")
        .when(F.col("any").isNull(), "missing")
        .when(next_.isNull(), "sent")
        .when(next_["status"] == "sending", "ambiguous")
        .when(stuck, "none")
        .otherwise("send")
    )
    return joined.select("envelope_id", action.alias("action"), F.when(action.isin("send", "ambiguous"), next_["position"]).alias("position"))


def finish(envelopes: DataFrame, chunks: DataFrame, leads: DataFrame, results: DataFrame, now: Column, jitter: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(envelopes, chunks, leads) after the `results` of attempts: envelope_id, position, message_id, error (null: sent), retry_after.

    `envelopes`: envelope_id, lead_id, status, message_id, last_error, sent_at;
    `chunks`: envelope_id, position, status, message_id, last_error, attempts,
    next_attempt_at, sent_at; `leads`: lead_id, status. An ambiguous send stays
    ambiguous, other errors are failures, and only those worth another try get a
    time for it. When its last chunk is sent the envelope is, and a new lead is
    notified.
    """
    # One result a chunk at a time; it decides the chunk's new state.
    r = results.select("envelope_id", "position", F.struct("message_id", "error", "retry_after").alias("_r"))
    joined = chunks.join(r, ["envelope_id", "position"], "left")
    told, failed = F.col("_r").isNotNull(), F.col("_r.error").isNotNull()
    wait = outcomes.backoff(F.col("attempts"), F.coalesce("_r.retry_after", F.lit(0.0)), F.lit(0.0) if jitter is None else jitter)
    due = F.when(F.col("_r.error").isin(*RETRYABLE), F.timestamp_micros((F.unix_micros(now) + wait * 1e6).cast("long"))).when(failed, F.col("next_attempt_at"))
    new = {
        "status": F.when(~failed, "sent").when(F.col("_r.error") == "ambiguous", "ambiguous").otherwise("failed"),
        "message_id": F.when(failed, F.col("message_id")).otherwise(F.col("_r.message_id")),
        "last_error": F.col("_r.error"),
        "next_attempt_at": due,
        "sent_at": F.when(failed, F.col("sent_at")).otherwise(now),
    }
    after = joined.select(*(F.when(told, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in chunks.columns))
    left = after.groupBy("envelope_id").agg(F.count_if(F.col("status") != "sent").alias("_left"))
    last = r.groupBy("envelope_id").agg(F.max_by("_r", "position").alias("_r"))
    touched = envelopes.join(last, "envelope_id", "left").join(left, "envelope_id", "left")
    over = told & ~failed & (F.col("_left") == 0)
    change = {
        "status": F.when(failed, "failed").when(over, "sent").otherwise(F.col("status")),
        "message_id": F.when(failed, F.col("message_id")).otherwise(F.col("_r.message_id")),
        "last_error": F.col("_r.error"),
        "sent_at": F.when(over, now).otherwise(F.col("sent_at")),
    }
    done = touched.select(*(F.when(told, change[c]).otherwise(F.col(c)).alias(c) if c in change else F.col(c) for c in envelopes.columns))
    named = touched.where(over & F.col("lead_id").isNotNull()).select("lead_id").distinct().withColumn("_told", F.lit(True))
    status = F.when(F.col("_told") & (F.col("status") == "new"), "notified").otherwise(F.col("status"))
    return done, after, leads.join(named, "lead_id", "left").select(*(status.alias(c) if c == "status" else c for c in leads.columns))


@dataclass(frozen=True)
class Recipient:
    """Who is to get a digest, and of which period."""

    recipient: str
    period: str
    paused: bool = False
    explicit: bool = False


def reserve_digest(leads: DataFrame, sent: DataFrame, envelopes: DataFrame, markers: DataFrame, recipients: list[Recipient], threshold: int = 55) -> DataFrame:
    """(recipient, period, lead_id, rank): what each recipient's new digest holds, best first.

    None is made for a pause that isn't overruled, or a period that has an
    envelope (`envelopes`: recipient, period) or a marker of an expired one
    (`markers`: recipient, period). A lead (lead_id, score, status, at) enters if
    it is active, reaches the threshold, and was in no digest of that recipient
    (`sent`: recipient, lead_id). Recipients are stated by the caller, so a lead
    is written once for each of them.
    """
    named = [F.struct(F.lit(r.recipient).alias("recipient"), F.lit(r.period).alias("period")) for r in recipients if r.explicit or not r.paused]
    usable = leads.where((F.col("score") >= threshold) & F.col("status").isin(*ACTIVE))
    offered = usable.withColumn("_to", F.explode(F.array(*named) if named else F.array().cast("array<struct<recipient:string,period:string>>"))).select("*", "_to.*")
    new = offered.join(envelopes, ["recipient", "period"], "left_anti").join(markers, ["recipient", "period"], "left_anti").join(sent, ["recipient", "lead_id"], "left_anti")
    best = Window.partitionBy("recipient", "period").orderBy(F.desc("score"), F.desc("at"), "lead_id")
    return new.select("recipient", "period", "lead_id", F.row_number().over(best).alias("rank"))
