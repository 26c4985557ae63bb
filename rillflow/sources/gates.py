"""Which sources may be read now, and by which reader."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Source:
    """A source of the registry; its options are its reader's business."""

    key: str
    kind: str
    enabled: bool = False
    policy_status: str = "pending"
    authorized_until: datetime | None = None
    paused_until: datetime | None = None
    options: dict = field(default_factory=dict)

    def closed(self, now: datetime) -> str | None:
        """Why the source may not be read, or None. Bounds are exclusive: a pause is over when its time has come."""
        if not self.enabled:
            return "disabled"
        if self.policy_status != "approved":
            return "not_approved"
        if self.authorized_until is not None and self.authorized_until <= now:
            return "authorization_expired"
        return "paused" if self.paused_until is not None and self.paused_until > now else None


def open_source(source: Source, readers: dict[str, Callable[[Source], DataFrame]], now: datetime) -> DataFrame:
    """The rows of a source by the reader of its kind; ValueError if it is closed or of no known kind."""
    reason = source.closed(now)
    if reason or source.kind not in readers:
        raise ValueError(f"{source.key}: {reason or 'no reader for its kind'}")
    return readers[source.kind](source)


def may_read(now: Column) -> Column:
    """The same gates over a table of sources; what isn't known to be open is closed."""
    held = F.coalesce(F.col("paused_until") > now, F.lit(False)) | F.coalesce(F.col("authorized_until") <= now, F.lit(False))
    return F.coalesce(F.col("enabled"), F.lit(False)) & F.coalesce(F.col("policy_status") == "approved", F.lit(False)) & ~held
