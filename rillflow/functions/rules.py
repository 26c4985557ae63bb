"""Rule packs, classification, field extraction and scores as column functions."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from rillflow.functions.text import PHONE, java


@dataclass(frozen=True)
class Rule:
    """A pattern that speaks for one intent or for one subject."""

    id: str
    pattern: str
    intent: str | None = None
    subject: str | None = None
    priority: int = 0
    confidence: float = 0.9

    def __post_init__(self):
        if not re.fullmatch("[a-z][a-z0-9_]*", self.id):
            raise ValueError(f"{self.id}: an id is made of a-z, 0-9 and _")
        if (self.intent is None) == (self.subject is None):
            raise ValueError(f"{self.id}: a rule has an intent or a subject")
        if not self.pattern or not 0 <= self.confidence <= 1:
            raise ValueError(f"{self.id}: a rule has a pattern and a confidence from 0 to 1")
        re.compile(self.pattern, re.I)


@dataclass(frozen=True)
class RulePack:
    """Rules, phrases that texts are compared without, and the subjects in the order in which they win."""

    version: str
    rules: tuple[Rule, ...]
    boilerplate: tuple[str, ...] = ()
    subjects: tuple[str, ...] = ()
    #: (a, b, what both together are).
    combined: tuple[str, str, str] | None = None

    def __post_init__(self):
        if len({r.id for r in self.rules}) != len(self.rules):
            raise ValueError("ids of rules are unique")


# The rules for requests, and the subjects' order.
REQUESTS = RulePack(
    version="rules-v2",
    boilerplate=("Репост из родительского чата", "Подписывайтесь на наш канал"),
    rules=(
        Rule("intent_job", r"\b(?:(?<!не )ваканси\w*|в штат|зарплат\w*|трудоустройств\w*|(?:школа|лицей|гимназия)\s+(?:ищет|приглашает)|(?:школе|лицею|гимназии)\s+требуется|(?<!не )требуется\s+учител\w*[^.!?]{0,60}\bв\s+(?:школу|лицей|гимназию)|school\s+seeks)\b", intent="teaching_job", priority=100),
        Rule("intent_agency", r"\b(образовательн\w*\s+центр|школа\s+объявляет\s+набор|набор\s+на\s+курс|авторский\s+курс)\b", intent="school_or_agency_ad", priority=90),
        Rule("intent_offer", r"\b(я\s+репетитор|набираю\s+учеников|провожу\s+занятия|мои\s+услуги|(?:предлагаю|оказываю)\s+(?:помощь|услуги)|i\s+am\s+a\s+\w*\s*tutor)\b", intent="offering_tutoring", priority=80),
        Rule("intent_seek_explicit", r"\b(?:(?:ищу|ищем|нужен|нужна|требуется|посоветуйте|порекомендуйте)\s+(?:хорош\w+\s+)?(?:репетитор\w*|преподавател\w*|учител\w*)|looking\s+for\s+a\s+(?:literature\s+)?tutor)\b", intent="seeking_tutor", priority=70, confidence=0.98),
        Rule("intent_negated_request", r"\b(?:не\s+(?:ищу|ищем)|не\s+(?:нуж(?:ен|на|но)|требуется)\s+(?:репетитор\w*|учител\w*|преподавател\w*|помощь|помочь|подтянуть)|(?:репетитор\w*|учител\w*|помощь)(?:\s+(?:с|по)\s+литератур\w*)?\s+не\s+(?:нуж(?:ен|на)|требуется)|не\s+нужно\s+подготовить)\b", intent="uncertain", priority=75, confidence=0.7),
        Rule("intent_seek_indirect", r"\b(подтянуть\s+литературу|(?:помочь\s+(?:дочери\s+|сыну\s+)?|(?:нужна|требуется)\s+помощь\s+)(?:с\s+литературой|с\s+сочинением)|проблемы\s+с\s+литературой|просела\s+литература|кто\s+(?:может\s+позаниматься|готовит\s+к)|нужно\s+подготовить\s+к)\b", intent="seeking_tutor", priority=60, confidence=0.8),
        Rule("intent_info", r"\b(расписание|результаты\s+экзамен|новости|опубликован\w*|информация\s+о)\b", intent="informational", priority=10),
        Rule("subject_literature", r"\b(литератур\w*|literature)\b", subject="literature"),
        Rule("subject_russian", r"\b(русск\w*|russian)\b(?!\s+(?:(?:классическ|современн|отечественн)\w*\s+)?(?:литератур\w*|literature)\b)", subject="russian_language"),
        Rule("subject_other", r"\b(математик\w*|физик\w*|хими\w*|английск\w*|биологи\w*)\b", subject="other"),
    ),
    subjects=("russian_and_literature", "literature", "russian_language", "other"),
    combined=("literature", "russian_language", "russian_and_literature"),
)

# A pack for the generated documents, in a form that Java, RE2 and Python read alike.
GENERIC = RulePack(
    version="generic-1",
    rules=(
        Rule("email", r"[a-z0-9._]+@[a-z0-9.]+", intent="contact", priority=60, confidence=0.8),
        Rule("ip", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", intent="network", priority=70),
        Rule("license", r"(licensed under|released under|is licensed under)", intent="license", priority=90, confidence=0.98),
        Rule("phone", r"\+[0-9]+ \([0-9]{3}\) [0-9-]+", intent="contact", priority=65),
        Rule("secret", r"(token|key|secret|password) ?= ?", intent="secret", priority=100),
        Rule("table_row", r" \| ", subject="table"),
        Rule("shouting", r"[a-z]{4,}!!", subject="noise"),
    ),
    subjects=("both", "table", "noise"),
    combined=("table", "noise", "both"),
)


def hits(text: Column, pack: RulePack = GENERIC) -> Column:
    """The ids of all rules that match, whatever the case, in the order of the pack."""
    return F.array_compact(F.array(*[F.when(text.rlike(java(r.pattern)), F.lit(r.id)) for r in pack.rules]))


def intent(matched: Column, pack: RulePack = GENERIC, default: str = "uncertain") -> tuple[Column, Column]:
    """(intent, confidence) of the matched rule with the highest priority, ties by id."""
    out, sure = F.lit(default), F.lit(0.0)
    for r in sorted((r for r in pack.rules if r.intent), key=lambda r: (-r.priority, r.id), reverse=True):
        out = F.when(F.array_contains(matched, r.id), F.lit(r.intent)).otherwise(out)
        sure = F.when(F.array_contains(matched, r.id), F.lit(r.confidence)).otherwise(sure)
    return out, sure


def subject(matched: Column, pack: RulePack = GENERIC) -> Column:
    """The first of the pack's subjects that a matched rule speaks for, or the combined one where both its parts are."""
    rules = {s: [F.lit(r.id) for r in pack.rules if r.subject == s] for s in pack.subjects}
    has = {s: F.arrays_overlap(matched, F.array(*ids)) for s, ids in rules.items() if ids}
    out = F.lit("unknown")
    for s in reversed(list(has)):
        out = F.when(has[s], F.lit(s)).otherwise(out)
    if pack.combined:
        a, b, both = pack.combined
        out = F.when(has[a] & has[b], F.lit(both)).otherwise(out)
    return out


SPANS = "array<struct<rule_id:string,start:int,end:int>>"


def spans(patterns: tuple[tuple[str, str], ...]):
    """A function of a text column: every match of the (id, pattern) pairs, whatever the case, as struct(rule_id, start, end) in code points."""

    @F.pandas_udf(SPANS)
    def find(texts: pd.Series) -> pd.Series:
        compiled = [(i, re.compile(p, re.I)) for i, p in patterns]
        return texts.fillna("").map(lambda t: [{"rule_id": i, "start": m.start(), "end": m.end()} for i, p in compiled for m in p.finditer(t)])

    return find


def rule_spans(pack: RulePack = GENERIC):
    return spans(tuple((r.id, r.pattern) for r in pack.rules))


# Fixed values of field extraction.
GOALS = (
    ("school_support", r"подтянуть|школьн\w*\s+программ|школьн\w*\s+поддерж|домашн\w*\s+задани"),
    ("essay", r"сочинени\w*|эссе"),
    ("oge", r"\bогэ\b"),
    ("ege", r"\bегэ\b"),
    ("olympiad", r"олимпиад\w*"),
    ("vsosh", r"\bвсош\b|всероссийск\w*\s+олимпиад"),
    ("admissions", r"поступлени\w*|вступительн\w*\s+экзамен"),
    ("adult_study", r"для\s+взросл\w*|взрослый\s+ученик"),
)
GRADE = r"\b(\d{1,2})(?:\s*-?\s*(?:й|м|го|ый))?\s*класс\w*\b|\bgrade\s+(\d{1,2})\b"
GRADE_RANGE = r"\b\d{1,2}\s*[-/]\s*\d{1,2}\s*класс"
PLACE = r"\b(?:город|г\.)\s*([А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?)\b"
BUDGET = r"\b(?:до\s+|от\s+)?\d[\d ]*(?:\s*-\s*\d[\d ]*)?\s*(?:руб(?:лей|ля|ль)?\.?|₽)(?:\s*(?:/|за)\s*(?:час|урок|занятие))?"
CONTACT = PHONE + r"|\B@[A-Za-z][A-Za-z0-9_]{4,}\b|\bпишите\s+в\s+(?:личку|лс)\b"
CLOSED = r"\b(?:уже\s+нашли|репетитор\s+найден|заявка\s+закрыта|больше\s+не\s+актуально)\b"


ONLINE, NOT_ONLINE = r"\bонлайн\b|\bдистанционно\b", r"\bне\s+(онлайн|дистанционно)\b"
OFFLINE, NOT_OFFLINE = r"\bофлайн\b|\bоффлайн\b|\bочно\b", r"\bне\s+(офлайн|оффлайн|очно)\b"
URGENT, NOT_URGENT = r"\bсрочно\b|\bкак\s+можно\s+скорее\b", r"\bне\s+срочно\b|\bне\s+спешим\b"
#: What an extracted field rests on, in the order of the evidence.
EVIDENCE = (
    ("grade", GRADE), *((f"goal_{name}", pattern) for name, pattern in GOALS), ("format_online", ONLINE), ("format_offline", OFFLINE),
    ("location", PLACE), ("urgency_high", URGENT), ("urgency_low", NOT_URGENT), ("budget", BUDGET), ("contact", CONTACT), ("closed", CLOSED),
)


def field_spans():
    """A function of a readable text: the matches that its fields rest on; see `spans`."""
    return spans(EVIDENCE)


def extract_fields(text: Column, response_available: Column | None = None) -> Column:
    """struct(grade, goals, format, location_text, urgency, budget_text, contact_available, closed)."""
    has = lambda p: text.rlike(java(p))
    every = lambda p, g=0: F.regexp_extract_all(text, F.lit(java(p)), F.lit(g))
    numbers = F.array_distinct(F.transform(F.filter(F.concat(every(GRADE, 1), every(GRADE, 2)), lambda x: x != ""), lambda x: x.cast("int")))
    grade = F.when((F.size(numbers) == 1) & ~has(GRADE_RANGE) & F.get(numbers, F.lit(0)).between(1, 11), F.get(numbers, F.lit(0)))
    online = has(ONLINE) & ~has(NOT_ONLINE)
    offline = has(OFFLINE) & ~has(NOT_OFFLINE)
    place, budget = every(PLACE, 1), every(BUDGET)
    return F.struct(
        grade.alias("grade"),
        F.array_compact(F.array(*[F.when(has(p), F.lit(g)) for g, p in GOALS])).alias("goals"),
        F.when(online & offline, "either").when(online, "online").when(offline, "offline").otherwise("unknown").alias("format"),
        F.when(F.size(place) == 1, F.get(place, F.lit(0))).alias("location_text"),
        F.when(has(NOT_URGENT), "low").when(has(URGENT), "high").otherwise("unknown").alias("urgency"),
        F.when(F.size(budget) == 1, F.trim(F.get(budget, F.lit(0)))).alias("budget_text"),
        (has(CONTACT) | (F.lit(False) if response_available is None else F.coalesce(response_available, F.lit(False)))).alias("contact_available"),
        has(CLOSED).alias("closed"),
    )


def completeness(fields: Column) -> Column:
    """How many of the fields are known; each goal counts."""
    some = (fields["grade"].isNotNull(), fields["format"] != "unknown", fields["location_text"].isNotNull(), fields["budget_text"].isNotNull(), fields["urgency"] != "unknown", fields["contact_available"])
    return sum((c.cast("int") for c in some), F.size(F.array_distinct(fields["goals"])))


def eligible(kind: Column, topic: Column, score: Column, review: int = 45) -> Column:
    """Whether an item may found a lead: a request, or perhaps one, of a wanted subject, with the score for a review."""
    return kind.isin("seeking_tutor", "uncertain") & topic.isin("literature", "russian_and_literature") & (score >= review)


def compatible(left: Column, right: Column) -> Column:
    """Whether the fields of two items may be of one request: a conflict needs both sides to be known."""

    def differ(name, make=lambda c: c, known=lambda c: c.isNotNull()):
        a, b = left[name], right[name]
        return known(a) & known(b) & (make(a) != make(b))

    some = lambda c: c.isNotNull() & (c != "")
    formats = F.array_sort(F.array(left["format"], right["format"])) == F.array(F.lit("offline"), F.lit("online"))
    conflict = differ("grade") | differ("goals", lambda c: F.array_sort(F.array_distinct(c)), lambda c: F.size(c) > 0) | formats | differ("location_text", F.lower, some) | differ("budget_text", known=some)
    return ~F.coalesce(conflict, F.lit(False))


# Weights in the order of the explanation, and thresholds.
WEIGHTS = {
    "seeking_tutor": 25,
    "literature": 30,
    "russian_and_literature": 15,
    "exam": 10,
    "olympiad": 12,
    "online": 8,
    "grade_stated": 4,
    "fresh": 6,
    "budget_stated": 3,
    "contact_available": 2,
    "offering_tutoring": -70,
    "school_or_agency_ad": -55,
    "teaching_job": -35,
    "closed_or_stale": -50,
}
THRESHOLDS = {"review": 45, "digest": 55, "immediate": 90}


def reasons(features: dict[str, Column], weights: dict[str, int]) -> Column:
    """array(struct(rule_id, delta)) of the features that apply, in their order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(on, F.lit(False)), F.struct(F.lit(k).alias("rule_id"), F.lit(weights[k]).alias("delta"))) for k, on in features.items()]))


def total(found: Column) -> Column:
    """The sum of the deltas, within 0 and 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.aggregate(found, F.lit(0), lambda s, r: s + r["delta"])))


def request_features(kind: Column, topic: Column, fields: Column, published: Column, now: Column, fresh_hours: int = 12, stale_days: int = 30) -> dict[str, Column]:
    """The features of a request, in the order of WEIGHTS."""
    age = now.cast("timestamp").cast("double") - published.cast("timestamp").cast("double")
    any_goal = lambda *g: F.arrays_overlap(fields["goals"], F.array(*[F.lit(x) for x in g]))
    return {
        "seeking_tutor": kind == "seeking_tutor",
        "literature": topic == "literature",
        "russian_and_literature": topic == "russian_and_literature",
        "exam": any_goal("ege", "oge"),
        "olympiad": any_goal("olympiad", "vsosh"),
        "online": fields["format"].isin("online", "either"),
        "grade_stated": fields["grade"].isNotNull(),
        "fresh": (age >= 0) & (age < fresh_hours * 3600),
        "budget_stated": fields["budget_text"].isNotNull(),
        "contact_available": fields["contact_available"],
        "offering_tutoring": kind == "offering_tutoring",
        "school_or_agency_ad": kind == "school_or_agency_ad",
        "teaching_job": kind == "teaching_job",
        "closed_or_stale": fields["closed"] | F.coalesce(age >= stale_days * 86400, F.lit(False)),
    }
