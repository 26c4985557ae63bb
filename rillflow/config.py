"""Settings from YAML files: strict, with errors that show no values."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path

from rillflow.functions.rules import REQUESTS, THRESHOLDS, WEIGHTS, Rule, RulePack
from rillflow.operators.retention import Periods


class ConfigError(ValueError):
    """A file that can't be used; says which and where, not what stands there."""


@dataclass(frozen=True)
class Scoring:
    version: str = "rules-v2"
    fresh_hours: int = 12
    stale_days: int = 30
    thresholds: dict = field(default_factory=lambda: dict(THRESHOLDS))
    weights: dict = field(default_factory=lambda: dict(WEIGHTS))

    def __post_init__(self):
        t = self.thresholds
        if set(t) != set(THRESHOLDS) or not 0 <= t["review"] < t["digest"] < t["immediate"] <= 100:
            raise ValueError("thresholds rise from review to immediate")
        if set(self.weights) != set(WEIGHTS) or not all(type(w) is int for w in self.weights.values()):
            raise ValueError("each feature has a weight")
        if self.fresh_hours < 1 or self.stale_days < 1:
            raise ValueError("periods are positive")


@dataclass(frozen=True)
class Business:
    timezone: str = "UTC"
    timezone_display_name: str = "UTC"
    digest_time: str = "09:00:00"
    send_empty_digest: bool = False
    retention: Periods = Periods()
    window_days: int = 30
    similarity_threshold: int = 90


@dataclass(frozen=True)
class Settings:
    pack: RulePack = REQUESTS
    scoring: Scoring = Scoring()
    business: Business = Business()
    sources: tuple[dict, ...] = ()
    queries: dict = field(default_factory=dict)


def _only(kind, given: dict):
    """`kind` of the given values; keys it doesn't have are an error."""
    if unknown := set(given) - {f.name for f in fields(kind)}:
        raise ValueError(f"unknown keys: {', '.join(sorted(unknown))}")
    return kind(**given)


def _pack(given: dict) -> RulePack:
    rules = tuple(_only(Rule, r) for r in given.pop("rules"))
    return RulePack(rules=rules, boilerplate=tuple(given.pop("boilerplate", ())), subjects=REQUESTS.subjects, combined=REQUESTS.combined, version=given.pop("version"), **given)


def _business(given: dict) -> Business:
    days, dedup = given.pop("retention", {}), given.pop("deduplication", {})
    periods = Periods(**{name.removesuffix("_days").removeprefix("raw_"): value for name, value in days.items()})
    return _only(Business, given | {"retention": periods} | dedup)


def _sources(given: dict) -> tuple[dict, ...]:
    keys = [s["key"] for s in given["sources"]]
    if len(set(keys)) != len(keys):
        raise ValueError("keys of sources are unique")
    if any(s.get("enabled") and s.get("policy_status") != "approved" for s in given["sources"]):
        raise ValueError("only approved sources are enabled")
    return tuple(given["sources"])


def _queries(given: dict) -> dict:
    listed = given["queries"]
    if len({q["id"] for q in listed}) != len(listed):
        raise ValueError("ids of queries are unique")
    return {q["id"]: q["text"] for q in listed}


PARTS = {"processing": ("pack", _pack), "scoring": ("scoring", lambda g: _only(Scoring, g)), "business": ("business", _business), "sources": ("sources", _sources), "queries": ("queries", _queries)}


def load_settings(folder: str) -> Settings:
    """The settings of the YAML files of a folder; a file that isn't there leaves the defaults.

    ConfigError for anything that isn't known or doesn't hold.
    """
    import yaml

    found = {}
    for name, (part, make) in PARTS.items():
        path = Path(folder) / f"{name}.yml"
        if not path.exists():
            continue
        try:
            given = yaml.safe_load(path.read_text(encoding="utf-8"))
            if not isinstance(given, dict):
                raise ValueError("not a mapping")
            found[part] = make(dict(given))
        except (yaml.YAMLError, ValueError, TypeError, KeyError, AttributeError) as error:
            raise ConfigError(f"{path.name}: {type(error).__name__}") from None
    return Settings(**found)
