"""JSON log lines that can't carry free text: named fields only."""

from __future__ import annotations

import json
import logging
from datetime import datetime, timezone

# The fields that a line may hold beside its time, level and event.
FIELDS = ("run_id", "source_key", "record_id", "status", "duration_ms", "items_seen", "items_inserted", "items_failed", "error_category")


class JsonLines(logging.Formatter):
    """One JSON object a record; arguments, tracebacks and other extras are left out, and so are other libraries' messages."""

    def format(self, record: logging.LogRecord) -> str:
        own = record.name.partition(".")[0] == __name__.partition(".")[0]
        line = {"timestamp": datetime.fromtimestamp(record.created, timezone.utc).isoformat(), "level": record.levelname, "event": record.msg if own else "dependency_log"}
        return json.dumps(line | {k: v for k, v in vars(record).items() if k in FIELDS}, ensure_ascii=False, default=str)
