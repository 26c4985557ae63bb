import pytest
from pyspark.sql import functions as F

from rillflow.functions import rules as R
from rillflow.functions import text as T


@pytest.mark.parametrize(
    "url, expected",
    [
        ("HTTP://Example.COM:80/a?b=2&a=1&utm_source=x#f", "http://example.com/a?a=1&b=2"),
        ("https://example.com", "https://example.com/"),
        ("https://user@example.com/", None),
        ("ftp://example.com/", None),
        ("https://example.com:99999/", None),
        ("https://example.com/?ref=1&q=", "https://example.com/?q="),
        ("http://example.com:0/", "http://example.com:0/"),
        ("http://[2001:DB8::1]:443/", "http://[2001:db8::1]:443/"),
        ("https://почта.рф/?b=я", "https://xn--80a1acny.xn--p1ai/?b=%D1%8F"),
        (None, None),
    ],
)
def test_canonical(url, expected):
    assert T.canonical(url) == expected


@pytest.mark.parametrize(
    "url, expected",
    [
        ("https://Example.com./x?b=1&a=2&utm_id=3&ref=y", "https://example.com/x?b=1&a=2&ref=y"),
        ("http://localhost/", None),
        ("http://10.0.0.1/", None),
        ("http://a b.com/", None),
        ("http://8.8.8.8/", "http://8.8.8.8/"),
        ("http://8.8.8.8./", None),
        ("http://a.123/", "http://a.123/"),
        ("http://1.2.3/", None),
        ("https://example.com/?a=1&&b=2&utm%5Fx=1&msclkid=3&a=1", "https://example.com/?a=1&&b=2&a=1"),
        ("https://example.com:0/", None),
        ("https://" + ".".join(["a" * 60] * 5) + "/", None),
        ("https://x.local/", None),
        ("https://-a.com/", None),
        ("https://a@example.com/", None),
        ("https://example.com/a\\b", None),
        (None, None),
    ],
)
def test_public(url, expected):
    assert T.public(url) == expected


def test_normal_form(spark):
    rows = spark.createDataFrame([("«Ёж»  —  Straße…",), (None,), ("",)], "text string")
    got = [r[0] for r in rows.select(T.fingerprint_text(T.readable(F.col("text")))).collect()]
    assert got == ["еж strasse", "", ""]


def test_placeholders_and_rewriting(spark):
    rows = spark.createDataFrame([("см. http://a.b/x?utm_id=1. Тел. 8 (999) 123-45-67",)], "text string")
    assert rows.select(T.fingerprint_text(T.readable(F.col("text")))).first()[0] == "см urltoken тел phonetoken"
    assert rows.select(T.readable(F.col("text"))).first()[0].startswith("см. http://a.b/x. Тел")


def test_normal_form_by_the_definition(spark):
    import re
    import unicodedata

    texts = ["ﬁne ½ ａｂｃ ０１", "ΟΔΥΣΣΕΥΣ ΣΑΣ ς", "İstanbul ŉ ǰ", "e\u0301te\u0301 caf\u00e9", "a\u200bb\u00adc", "x http://user@h.com/a, y", "ЁЖ «да»…", "See HTTPS://EX.com:443/?utm_x=1!", "Straße ẞ", "\u1100\u1161\u11a8 한", "№ 5 Ⅳ", "tab\t\u00a0x\u2003y"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").select(T.readable(F.col("text")).alias("r")).select("r", T.fingerprint_text(F.col("r")).alias("f"))
    for text, row in zip(texts, frame.collect()):
        plain = T.punctuation(text)
        plain = re.sub(T.URL, lambda m: (T.canonical(m[0].rstrip(".,;!?)")) or "[url]") + m[0][len(m[0].rstrip(".,;!?)")) :], plain, flags=re.I)
        readable = re.sub(r"\s+", " ", plain).strip()
        folded = re.sub(T.PHONE, " phonetoken ", re.sub(T.URL, " urltoken ", unicodedata.normalize("NFKC", readable).casefold().replace("ё", "е"), flags=re.I))
        assert row.r == readable
        assert row.f == " ".join(re.findall(r"[^\W_]+", readable.casefold().replace("ё", "е") if "://" not in readable else folded)), text


def test_boilerplate_goes(spark):
    rows = spark.createDataFrame([("«Репост» из чата…  Ищу",)], "text string").select(T.readable(F.col("text")).alias("r"))
    assert rows.select(T.fingerprint_text(F.col("r"), ("«РЕПОСТ» из чата…",))).first()[0] == "ищу"


def test_similarity(spark):
    words = lambda s: F.array(*[F.lit(w) for w in s.split()])
    row = spark.range(1).select(T.similarity(words("a b c"), words("b c d")).alias("s"), T.similarity(F.array().cast("array<string>"), words("a")).alias("z")).first()
    assert (row.s, row.z) == (50.0, 0.0)


@pytest.mark.parametrize(
    "text, grade",
    [("Нужен репетитор, 9 класс", 9), ("для 10-го класса", 10), ("9-11 класс", None), ("8 класс и 9 класс", None), ("grade 7", 7), ("15 класс", None), ("без класса", None)],
)
def test_grades(spark, text, grade):
    rows = spark.createDataFrame([(text,)], "text string")
    assert rows.select(R.extract_fields(F.col("text")).alias("f")).select("f.grade").first()[0] == grade


def test_fields(spark):
    rows = spark.createDataFrame([("Ищу онлайн, не очно. ЕГЭ, сочинение. Не срочно. до 1500 руб за урок, пишите в лс",)], "text string")
    f = rows.select(R.extract_fields(F.col("text")).alias("f")).first().f
    assert (f.format, f.goals, f.urgency, f.budget_text, f.contact_available, f.closed) == ("online", ["essay", "ege"], "low", "до 1500 руб за урок", True, False)


def test_score_of_a_fresh_plain_request(spark):
    rows = spark.createDataFrame([("нужна литература",)], "text string")
    rows = rows.withColumn("f", R.extract_fields(F.col("text")))
    features = R.request_features(F.lit("seeking_tutor"), F.lit("literature"), F.col("f"), F.lit("2026-01-01 12:00:00"), F.lit("2026-01-01 13:00:00"))
    assert rows.select(R.total(R.reasons(features, R.WEIGHTS))).first()[0] == 61


def test_rules_need_one_target():
    with pytest.raises(ValueError):
        R.Rule("x", "a")


def test_lock_keys_and_spans(spark):
    import hashlib

    rows = spark.createDataFrame([("é a@b.c and a@b.d",)], "text string")
    key = int.from_bytes(hashlib.sha256("é a@b.c and a@b.d".encode()).digest()[:8], "big", signed=True)
    assert rows.select(T.lock_key(F.col("text"))).first()[0] == key
    assert [tuple(m) for m in rows.select(R.rule_spans()("text")).first()[0]] == [("email", 2, 7), ("email", 12, 17)]


def test_conflicts_need_both_sides(spark):
    rows = spark.createDataFrame([("9 класс онлайн", "9 класс"), ("9 класс", "8 класс"), ("онлайн", "очно"), ("", "г. Пермь")], "a string, b string")
    got = rows.select(R.compatible(R.extract_fields(F.col("a")), R.extract_fields(F.col("b")))).collect()
    assert [r[0] for r in got] == [True, False, False, True]


@pytest.mark.parametrize(
    "text, intent, subject",
    [
        ("ИЩУ РЕПЕТИТОРА по литературе", "seeking_tutor", "literature"),
        ("Не ищу репетитора, просто читаю", "uncertain", "unknown"),
        ("Требуется учитель русского языка в нашу гимназию, в школу", "teaching_job", "russian_language"),
        ("Русская литература и русский язык: нужен преподаватель", "seeking_tutor", "russian_and_literature"),
        ("Русская классическая литература", "uncertain", "literature"),
        ("Я репетитор, помогу с физикой", "offering_tutoring", "other"),
        ("Новости школы", "informational", "unknown"),
        ("Looking for a literature tutor", "seeking_tutor", "literature"),
        ("Просела литература, кто готовит к ЕГЭ?", "seeking_tutor", "literature"),
        ("", "uncertain", "unknown"),
    ],
)
def test_requests_are_told_apart(spark, text, intent, subject):
    matched = R.hits(T.readable(F.col("text")), R.REQUESTS)
    row = spark.createDataFrame([(text,)], "text string").select(R.intent(matched, R.REQUESTS)[0].alias("i"), R.subject(matched, R.REQUESTS).alias("s")).first()
    assert (row.i, row.s) == (intent, subject)


def test_rule_packs_are_strict(tmp_path):
    for bad in ({"id": "Bad"}, {"pattern": "("}, {"pattern": ""}, {"confidence": 2}, {"subject": "s"}):
        with pytest.raises((ValueError, __import__("re").error)):
            R.Rule(**({"id": "a", "pattern": "b", "intent": "i"} | bad))
    with pytest.raises(ValueError):
        R.RulePack("v", (R.Rule("a", "b", intent="i"), R.Rule("a", "c", intent="i")))
    from rillflow.config import ConfigError, load_settings

    assert load_settings(str(tmp_path)).scoring.weights == R.WEIGHTS
    (tmp_path / "scoring.yml").write_text("fresh_hours: 3\n")
    (tmp_path / "business.yml").write_text("timezone: Europe/Rome\nretention: {raw_rejected_days: 5, leads_days: 6}\ndeduplication: {window_days: 7}\n")
    (tmp_path / "processing.yml").write_text("version: v\nrules:\n- {id: a, pattern: b, intent: i}\n")
    (tmp_path / "sources.yml").write_text("sources:\n- {key: k, enabled: true, policy_status: approved}\n")
    (tmp_path / "queries.yml").write_text("queries:\n- {id: q, text: t}\n")
    got = load_settings(str(tmp_path))
    assert got.scoring.fresh_hours == 3 and got.business.retention.rejected == 5 and got.business.window_days == 7 and got.pack.rules[0].id == "a" and got.queries == {"q": "t"}
    for name, text in (("scoring", "secret_key: 1\n"), ("scoring", "thresholds: {review: 60, digest: 55, immediate: 90}\n"), ("sources", "sources:\n- {key: k, enabled: true, policy_status: pending}\n"), ("processing", "rules: 5\n"), ("business", "[1")):
        (tmp_path / f"{name}.yml").write_text(text)
        with pytest.raises(ConfigError) as error:
            load_settings(str(tmp_path))
        assert "secret" not in str(error.value)
        (tmp_path / f"{name}.yml").unlink()


def test_evidence_is_in_code_points(spark):
    text = "😀 10 класс, онлайн"
    got = spark.createDataFrame([(text,)], "text string").select(R.field_spans()("text")).first()[0]
    assert [(m.rule_id, text[m.start : m.end]) for m in got] == [("grade", "10 класс"), ("format_online", "онлайн")]


@pytest.mark.parametrize("hours, fresh, stale", [(0, True, False), (11.999, True, False), (12, False, False), (-1, False, False), (720, False, True), (719.9, False, False)])
def test_edges_of_freshness(spark, hours, fresh, stale):
    rows = spark.range(1).select(R.extract_fields(F.lit("x")).alias("f"))
    now = F.lit("2026-03-01 00:00:00").cast("timestamp")
    said = F.timestamp_seconds(F.unix_timestamp(now) - F.lit(hours * 3600))
    features = R.request_features(F.lit("x"), F.lit("y"), F.col("f"), said, now)
    row = rows.select(features["fresh"].alias("fresh"), features["closed_or_stale"].alias("stale")).first()
    assert (row.fresh, row.stale) == (fresh, stale)
