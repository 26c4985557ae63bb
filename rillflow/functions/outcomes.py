"""Kinds of failure, waiting times and the states that follow from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stored kinds of a provider's numbered errors; the one without numbers is that of all others.
WALL_ERRORS = {
    "authentication": (4, 5, 16, 27, 28),
    "access_or_policy": (2, 7, 11, 14, 15, 17, 18, 19, 20, 21, 23, 24, 25, 30, 37, 42, 203, 210),
    "rate_limit_or_quota": (6, 9, 29, 32, 103),
    "timeout": (36,),
    "transport": (1, 10),
    "permanent_request": (),
}
SEARCH_ERRORS = {"empty": (15,), "authorization": (31, 33, 42), "rate_limit": (32, 55), "provider_server": (20,), "provider_request": ()}
# What a failed delivery is, by the kind of its exception and of that one's cause.
DELIVERY_ERRORS = {"retry_after": "rate_limited", "forbidden": "authorization", "invalid_token": "authorization", "bad_request": "malformed", "provider": "permanent"}
NETWORK_ERRORS, NOTHING_SENT = ("network", "timeout"), ("connect_error", "connect_timeout", "pool_timeout")
LONGEST_DELAY, LONGEST_BACKOFF = 300, 300
OFFSET_END = r"(?:Z|[+-]\d\d:?\d\d)$"
MAIL_DATE = r"^(?:[A-Za-z]{3},\s*)?(\d{1,2} [A-Za-z]{3} \d{4} \d\d:\d\d(?::\d\d)?) (?:GMT|UTC?|Z|([+-]\d{4}))$"


def error_kind(code: Column, kinds: dict[str, tuple[int, ...]]) -> Column:
    """The kind of a numbered error; null has none."""
    out = F.when(code.isNull(), F.lit(None).cast("string"))
    for kind, codes in kinds.items():
        out = out.when(code.isin(*codes), kind) if codes else out
    return out.otherwise(next(kind for kind, codes in kinds.items() if not codes))


def delivery_error(error: Column, cause: Column) -> Column:
    """Whether a failed delivery may be tried again; a lost answer is ambiguous unless nothing was sent."""
    out = F.when(error.isin(*NETWORK_ERRORS) & F.coalesce(cause.isin(*NOTHING_SENT), F.lit(False)), "retryable")
    for name, kind in DELIVERY_ERRORS.items():
        out = out.when(error == name, kind)
    return out.otherwise("ambiguous")


def mail_time(value: Column) -> Column:
    """A time as in mail headers, with an offset or GMT; else null."""
    plain = F.regexp_extract(value, MAIL_DATE, 1)
    long = F.when(plain.rlike(r":\d\d:"), plain).otherwise(F.concat(plain, F.lit(":00")))
    offset = F.coalesce(F.nullif(F.regexp_extract(value, MAIL_DATE, 2), F.lit("")), F.lit("+0000"))
    return F.when(value.rlike(MAIL_DATE), F.try_to_timestamp(F.concat(long, F.lit(" "), offset), F.lit("d MMM yyyy HH:mm:ss xx")))


def explicit_time(value: Column) -> Column:
    """An ISO 8601 or mail time with an offset, else null: a time without one can't be placed."""
    return F.coalesce(F.when(value.rlike(OFFSET_END), F.try_to_timestamp(value)), mail_time(value))


def retry_delay(value: Column, now: Column) -> Column:
    """The seconds that a provider asks to wait, as a number or a time; null if over five minutes, past or malformed."""
    number = F.when(value.rlike(r"\A[0-9]+\z"), F.try_to_number(value, F.lit("9" * 38)).cast("double"))
    # Whole seconds, toward zero.
    until = (F.unix_micros(mail_time(value)) - F.unix_micros(now)) / 1000000
    seconds = F.when(F.coalesce(number, until) > -1, F.coalesce(number, until)).cast("long")
    return F.when((F.length(value) <= 100) & seconds.between(0, LONGEST_DELAY), seconds)


def backoff(attempt: Column, retry_after: Column, jitter: Column) -> Column:
    """Seconds until the next attempt: twice as long each time up to a bound, plus `jitter`, but no less than asked."""
    return F.greatest(F.coalesce(retry_after, F.lit(0.0)), F.least(F.lit(float(LONGEST_BACKOFF)), F.pow(F.lit(2.0), attempt)) + jitter)
