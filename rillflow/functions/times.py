"""Local days and times as instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_instant(day: Column, zone: str, time: str = "00:00:00") -> Column:
    """The instant of a local time of a day; the day's own offset counts."""
    local = F.concat(day.cast("date").cast("string"), F.lit(f" {time}")).cast("timestamp_ntz")
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local).cast("timestamp")


def day_bounds(day: Column, zone: str) -> tuple[Column, Column]:
    """(start, end) of a local day, the end being the start of the next: 23 or 25 hours where the clock is changed."""
    return local_instant(day, zone), local_instant(F.date_add(day.cast("date"), 1), zone)


def local_day(now: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), now.cast("timestamp_ntz")).cast("date")


def next_digest(now: Column, zone: str, time: str = "09:00:00") -> Column:
    """The next time of the digest: today's, if it is still to come, or else tomorrow's."""
    today = local_day(now, zone)
    due = local_instant(today, zone, time)
    return F.when(due > now, due).otherwise(local_instant(F.date_add(today, 1), zone, time))
