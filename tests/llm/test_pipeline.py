"""The pipeline against what its stages must do, each on its own input."""

import collections

import corpus_pipeline as pipeline
from rillflow.llm.storage import written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for name, stage in pipeline.STAGES:
        tables.append(written(stage(spark, tables[-1], SF), name))
    before, kept, cleaned, single, clean, pieces = (t.toPandas() for t in tables)
    assert all(t.columns == columns for t in tables[:-1])
    text = dict(zip(before.doc_id, before.text))
    assert all(text[i] == t for i, t in zip(kept.doc_id, kept.text)) and len(kept) <= len(before)
    # Lines of ten documents or more are gone, all others stay.
    key = lambda line: line.strip(" \t\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    seen = collections.Counter(k for t in kept.text for k in {key(x) for x in t.split("\n")} if k)
    expected = {i: "\n".join(x for x in t.split("\n") if seen[key(x)] < 10) for i, t in zip(kept.doc_id, kept.text)}
    assert dict(zip(cleaned.doc_id, cleaned.text)) == expected
    assert set(single.doc_id) <= set(cleaned.doc_id) and single.doc_id.is_unique
    assert not single[single.text != ""].text.duplicated().any()
    assert set(clean.doc_id) <= set(single.doc_id)
    assert set(pieces.doc_id) == set(clean.doc_id)
    whole = pieces.groupby("doc_id").agg({"length": "sum", "doc_tokens": "first"})
    assert (whole.length == whole.doc_tokens).all()


def test_stages_take_odd_tables(spark):
    """Nulls in any column, empty and very long texts, repeats, and columns named like those of the operators."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_lines long, kept_text string, class_id long, row string, hit string, copy string, id long"
    long = " ".join(f"w{i}" for i in range(20000))
    texts = [(1, "one two three four five six"), (1, "one two three four five six"), (2, "one two three four five six"), (3, None), (4, ""), (None, None), (None, "same text here of words"), (None, "same text here of words"), (7, long), (8, long + " end"), (9, "x")]
    frame = spark.createDataFrame([(i, t, None, "s", None, 5, "k", 6, None, "h", "c", 7) for i, t in texts], schema)
    counts = {}
    for name, stage in pipeline.STAGES:
        rows = written(stage(spark, frame, SF), f"odd-{name}")
        counts[name] = rows.count()
        if name != "packing":
            assert rows.columns == frame.columns
            assert rows.where("hit <> 'h' OR copy <> 'c' OR id <> 7 OR n_lines <> 5").count() == 0
        empty = stage(spark, frame.limit(0), SF)
        assert empty.count() == 0
    # Near copies: one row of ids 1 and 2, one of 7 and 8; rows without an id stay.
    assert counts == {"toxicity": 11, "line_dedup": 11, "near_dedup": 8, "decontamination": 11, "packing": counts["packing"]}
