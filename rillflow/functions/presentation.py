"""Cards and digests for people: labels, ages, dates and markup-safe text.

Text is measured in UTF-16 units, as messengers count it.
"""

from __future__ import annotations

import html
from itertools import accumulate

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What people read for stored names.
SUBJECT_LABELS = {
    "literature": "литература",
    "russian_and_literature": "русский язык и литература",
    "russian_language": "русский язык",
    "other": "другой предмет",
    "unknown": "предмет не указан",
}
GOAL_LABELS = {
    "school_support": "школьная программа",
    "essay": "сочинение",
    "oge": "ОГЭ",
    "ege": "ЕГЭ",
    "olympiad": "олимпиада",
    "vsosh": "ВСОШ",
    "admissions": "вступительные испытания",
    "adult_study": "занятия для взрослого",
    "other": "другая цель",
}
FORMAT_LABELS = {"online": "онлайн", "offline": "очно", "either": "онлайн или очно"}
URGENCY_LABELS = {"low": "невысокая срочность", "normal": "обычная срочность", "high": "срочно"}
REASON_LABELS = {
    "seeking_tutor": "ищут репетитора",
    "literature": "основной предмет — литература",
    "russian_and_literature": "русский язык и литература",
    "exam": "подготовка к ЕГЭ или ОГЭ",
    "olympiad": "олимпиада или ВСОШ",
    "online": "подходят онлайн-занятия",
    "grade_stated": "указан класс",
    "fresh": "свежее объявление",
    "budget_stated": "указан бюджет",
    "contact_available": "можно связаться с автором",
    "offering_tutoring": "реклама услуг репетитора",
    "school_or_agency_ad": "реклама школы, курсов или агентства",
    "teaching_job": "вакансия преподавателя",
    "closed_or_stale": "заявка закрыта или устарела",
}
RUN_LABELS = {
    "never_run": "ещё не запускался",
    "running": "выполняется",
    "succeeded": "завершён успешно",
    "partial": "завершён частично",
    "failed": "завершён с ошибкой",
}
ACTION_LABELS = {"i": "Интересно", "n": "Не подходит", "d": "Дубликат", "c": "Закрыто"}
NO_SUBJECT, NO_GOAL, NO_FORMAT, NO_URGENCY = "предмет не указан", "цель не указана", "формат не указан", "срочность не указана"
OTHER_REASON, NO_REASON, NO_TIME = "дополнительный фактор оценки", "нет данных", "время публикации неизвестно"
SNIPPET_NOTE = "Фрагмент поисковой выдачи, не полный текст объявления:"
CONTINUED = "Продолжение дайджеста"
LINK_LIMIT = 1200

#: What stays together when a text is cut: a character with its combining marks,
#: selectors and skin tones, everything tied by joiners, and the two halves of a flag.
TIES = r"[\P{ccc=0}\uFE0E\uFE0F\u200D\U0001F3FB-\U0001F3FF]"
CLUSTER = regex.compile(rf"(?:[\U0001F1E6-\U0001F1FF]{{2}}|.)(?:{TIES}|(?<=\u200D).)*", regex.S)
UNPRINTABLE = regex.compile(r"[\p{Cs}\p{Cc}--[\n\r\t]]", regex.V1)


def units(text: str) -> int:
    return len(text) + sum(c > "\uffff" for c in text)


def safe(text: str | None, budget: int = 100) -> str:
    """`text` with markup characters escaped, in at most `budget` units; what is cut ends in an ellipsis. None is empty."""
    pieces = [html.escape(c) for c in CLUSTER.findall(UNPRINTABLE.sub(" ", text or ""))]
    kept = sum(end < budget for end in accumulate(map(units, pieces)))
    return "".join(pieces[:kept]) + ("…" if kept < len(pieces) else "")


def safe_text(budget: int):
    """`safe` as a function of a text column."""

    @F.pandas_udf(StringType())
    def escape(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: safe(t, budget))

    return escape


def label(value: Column, names: dict[str, str], fallback: str) -> Column:
    """The label of a stored name, `fallback` for null and unknown ones."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, value), F.lit(fallback))


def labels(values: Column, names: dict[str, str], fallback: str) -> Column:
    """The labels of an array of names, in its order; null has none."""
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: label(v, names, fallback))


def age(published: Column, now: Column) -> Column:
    """How long ago in whole minutes, hours or days; times to come count as now."""
    seconds = F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(published))
    number = lambda size: F.floor(seconds / size).cast("string")
    return (
        F.when(published.isNull(), NO_TIME)
        .when(seconds < 3600, F.concat(number(60), F.lit(" мин назад")))
        .when(seconds < 86400, F.concat(number(3600), F.lit(" ч назад")))
        .otherwise(F.concat(number(86400), F.lit(" дн назад")))
    )


def display_date(day: Column) -> Column:
    return F.date_format(day, "dd.MM.yyyy")


def display_datetime(local: Column) -> Column:
    return F.date_format(local, "dd.MM.yyyy' в 'HH:mm")


def yes_no(value: Column) -> Column:
    return F.when(value, "да").otherwise("нет")


def link(url: Column) -> Column:
    """A markup link to an address, null for one that is missing, unprintable or too long."""
    escaped = F.replace(F.replace(F.replace(F.replace(F.replace(url, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))
    fits = (F.length(F.encode(escaped, "UTF-16LE")) <= 2 * LINK_LIMIT) & ~url.rlike(r"[\x00-\x1F]")
    return F.when(fits, F.concat(F.lit('<a href="'), escaped, F.lit('">Открыть оригинал</a>')))


def card(lead: Column, now: Column) -> Column:
    """The card of a lead, a line a part; parts that are unknown are left out.

    `lead` is a struct of score, subject, grade, goals, format, urgency,
    location, budget, reason_ids, source, published_at, is_snippet, excerpt and
    url, the url being null or already in its public or canonical form.
    """
    known = [
        label(lead["subject"], SUBJECT_LABELS, NO_SUBJECT),
        F.concat(lead["grade"].cast("string"), F.lit(" класс")),
        F.when(F.size(lead["goals"]) > 0, F.array_join(labels(lead["goals"], GOAL_LABELS, NO_GOAL), " · ")),
        F.when(lead["format"] != "unknown", label(lead["format"], FORMAT_LABELS, NO_FORMAT)),
        F.when(lead["urgency"] != "unknown", label(lead["urgency"], URGENCY_LABELS, NO_URGENCY)),
    ]
    why = F.array_join(F.slice(labels(lead["reason_ids"], REASON_LABELS, OTHER_REASON), 1, 3), "; ")
    some = lambda c, head: F.when(c != "", F.concat(F.lit(head), safe_text(100)(c)))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("<b>"), lead["score"].cast("string"), F.lit("/100</b> · "), safe_text(300)(F.concat_ws(" · ", *known))),
        some(lead["location"], "Место: "),
        some(lead["budget"], "Бюджет: "),
        F.concat(F.lit("Почему подходит: "), safe_text(240)(F.when(why == "", NO_REASON).otherwise(why))),
        F.concat(safe_text(120)(lead["source"]), F.lit(" · "), age(lead["published_at"], now)),
        F.when(lead["is_snippet"], SNIPPET_NOTE),
        safe_text(700)(lead["excerpt"]),
        link(lead["url"]),
    )


def digest_header(day: Column, zone: Column, counts: Column) -> Column:
    """The head of a day's digest; `counts` is a struct of collected, rejected, new_leads, immediate, digest, review, eligible."""
    at, n = display_date(day), lambda name: counts[name].cast("string")
    return F.concat(
        F.lit("Дайджест за "), at, F.lit(" · "), zone, F.lit("\nСтатистика за календарный день "), at,
        F.lit("\nСобрано: "), n("collected"), F.lit("; отсеяно: "), n("rejected"), F.lit("; новых заявок: "), n("new_leads"),
        F.lit("\nСрочные: "), n("immediate"), F.lit("; для дайджеста: "), n("digest"), F.lit("; на проверку: "), n("review"), F.lit("; в подборке: "), n("eligible"),
    )


def buttons(lead_hex: Column, number: Column | None = None) -> Column:
    """array(struct(label, data)) of the four answers to a lead, numbered in a digest."""
    named = lambda text: F.lit(text) if number is None else F.concat(number.cast("string"), F.lit(" " + text))
    return F.array(*[F.struct(named(text).alias("label"), F.concat(F.lit(f"{action}:"), lead_hex).alias("data")) for action, text in ACTION_LABELS.items()])


def callback(data: Column, callback_id: Column) -> Column:
    """struct(action, lead) of a button's data, null if it or the callback's id is malformed."""
    sound = data.rlike(r"\A[indc]:[0-9a-f]{32}\z") & F.length(callback_id).between(1, 128)
    return F.when(sound, F.struct(F.substring(data, 1, 1).alias("action"), F.substring(data, 3, 32).alias("lead")))
