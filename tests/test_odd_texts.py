"""Queries over odd texts against their SQL: none, empty, blank, line breaks and tabs, letters of many cases, URLs and phones, very long ones."""

from collections import Counter

import duckdb
import pytest

from rillflow import registry

TEXTS = [
    None, None, "", " \n", "licensed\nunder key  = x\t|\ty  |  z @ABC.de!!", "a | b LOUD!!  loud!!", "see http://Example.com/a?utm_x=1 or +7 (999) 123-45-67", "ﬁne ½ caſe Kİı!! ΣΑΣ ẞ ß Ё ё", "soft­hyphen zero​width é \U0001d41a",
    "token= x a | b", "nul\x00byte " * 3, "word " * 14_000, "one two three four five six", "one two three four five six",
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, "en" if i % 2 else None, "src", len(t or "")) for i, t in enumerate(TEXTS * 8)]
    # Two sources' windows, the second one of over two MB.
    rows += [(1000 + i, "long text " * 6_000, "en", "big", 60_000) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", ["normalize_fingerprint", "exact_duplicate_groups", "canonical_occurrence", "token_sets_anchors", "classify_rules", "score_reasons", "completeness_rank", "rule_match_spans", "wall_decode", "wall_read_on"])
def test_odd_texts_agree_with_sql(spark, odd, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{odd}/documents.parquet/*.parquet'")
    got = Counter(tuple(r) for r in registry.queries()[name](spark, odd).collect())
    assert got == Counter(con.execute(registry.oracle_sql()[name]).fetchall())
