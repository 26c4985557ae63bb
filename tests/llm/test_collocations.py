"""Collocations against a plain count of all phrases."""

import collections
import random
import re

import numpy as np
import pytest

from rillflow.llm.collocations import collocations, phrase_counts
from rillflow.llm.perfect_hash import PerfectHash

SCHEMA = "doc_id long, text string, lang string, w1 long, f long, slice int, id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, 2, 3, "x") for i, (t, lang) in enumerate(rows)], SCHEMA)


def counted(rows):
    lower = {i: i + 32 for i in range(65, 91)}
    counts = collections.defaultdict(collections.Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            for k in range(1, 5):
                counts["und" if lang is None else lang].update(words[i : i + k] for i in range(len(words) - k + 1))
    return counts


def expected(rows, least, top):
    out = []
    for lang, f in counted(rows).items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        candidates, found = {p: v for p, v in f.items() if len(p) > 1 and v >= least}, []
        for p, a in candidates.items():
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            inside = [b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= 80 * a for b in inside):
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -score) for i, (score, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng, vocabulary = random.Random(4), ["a", "B", "ccc", "é", "Éa", "x\x00y", "-", "don't", "日本", "\x0b", "  ", "\t", "e.g", "\x1f", "end"]
    out = []
    for _ in range(300):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 40))]
        if rng.random() < 0.5:
            words[3:3] = ["the", "same", "Four", "words"]
        out.append((rng.choice([" ", " ", "  "]).join(words) + rng.choice(["", ".", " , "]), rng.choice(["en", "en", "und", None, "", "long name"])))
    return out + [(None, "en"), ("", "en"), ("...", None), ("\n \t", "en"), ("word", "rare"), ("a " * 60000, "en"), ("tail of", "en"), ("this", "en")] + out[:40]


@pytest.mark.parametrize("settings", [{}, {"slice_keys": 40, "salts": 3}, {"sieve": 64, "members": 64}])
def test_against_a_plain_count(spark, rows, settings):
    got = sorted(map(tuple, collocations(frame(spark, rows), least=5, top=50, **settings).collect()))
    assert got == expected(rows, 5, 50) and max(len(r[2].split(" ")) for r in got) == 4


def test_ties_at_the_last_place(spark):
    rows = [(f"p{i} q{i}", "en") for i in range(9)] * 3
    got = collocations(frame(spark, rows), least=3, top=4).orderBy("rank").collect()
    assert [r.phrase for r in got] == [f"p{i} q{i}" for i in range(4)] and {r.score for r in got} == {1_000_000}


def test_phrases_over_blocks_of_a_long_text(spark, monkeypatch):
    rows = [(" ".join(f"w{i % 7}" for i in range(5000)), "en"), ("w0 w1", "en")]
    monkeypatch.setattr("rillflow.llm.collocations.BLOCK_IDS", 10)
    _, frequent = phrase_counts(frame(spark, rows), least=1)
    assert sorted(r.f for r in frequent.collect()) == sorted(counted(rows)["en"].values())


def test_empty_tables(spark):
    assert collocations(frame(spark, [("x", "en")]).limit(0)).count() == 0
    assert collocations(frame(spark, [(None, None), ("", "en")])).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 50, (3000, 4)).astype(np.uint64), axis=0)
    table = PerfectHash.from_bytes(PerfectHash.build(keys).to_bytes())
    slots = table.slots(keys.T)
    assert sorted(slots.tolist()) == list(range(len(keys))) and (table.keys[slots] == keys).all()
    assert (table.slots(rng.integers(50, 90, (1000, 4)).astype(np.uint64).T) == -1).all()
    assert (PerfectHash.build(keys[:0]).slots(keys.T) == -1).all()
    with pytest.raises(ValueError):
        PerfectHash.build(np.concatenate([keys, keys[:1]]))
