"""Formatted conversations: exact round trips, turn by turn and under the mask."""

import hashlib
import random

import pyarrow as pa

from rillflow.llm import chat_format
from rillflow.llm.chat_format import CONTROL, digests, format_chats, masked, read_turns
from rillflow.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, part int, loss_mask string, together string, t1 string"
PIECES = [c.decode() for c in CONTROL] + ["\\", "\\\\", "<", "[", "é", "x", " ", "\n", "</", "s>", "INST]", "<<", "日本", "ok"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "m", "g", "t") for r in rows], SCHEMA)


def restored(formatted):
    """{conv_id: (turns, what is under the mask)}"""
    out = {}
    for r in sorted(formatted.collect(), key=lambda r: r.part):
        text, mask = r.text.encode(), bytes(r.loss_mask)
        assert len(text) == len(mask)
        turns, said = out.setdefault(r.conv_id, ([], []))
        own = [(a.decode(), b.decode()) for a, b in read_turns(text)]
        assert len(own) == r.n_turns
        turns.extend(own)
        said.append(masked(text, mask).decode())
    return {conv: (turns, "".join(said)) for conv, (turns, said) in out.items()}


def expected(rows):
    out = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        out.setdefault(conv, []).append((role or "", text or ""))
    return {conv: (turns, "".join(t for r, t in turns if r == "assistant")) for conv, turns in out.items()}


def random_rows():
    rng, rows = random.Random(3), []
    for conv in [None, *range(120)]:
        for turn in range(rng.randrange(1, 9)):
            text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 12)))
            role = rng.choice(["user", "assistant", "system", "tool", "to[TEXT]ol\\", "", None])
            rows.append((conv, None if turn == 0 and rng.random() < 0.1 else turn, role, rng.choice([text, text, None])))
    return rows


def test_round_trip(spark):
    rows = random_rows()
    assert restored(format_chats(frame(spark, rows))) == expected(rows)
    got = {r.conv_id: r for r in digests(format_chats(frame(spark, rows))).collect()}
    for conv, (turns, said) in expected(rows).items():
        whole = "".join(f"{role}\n{text}\n" for role, text in turns)
        row = got.pop(conv)
        assert (row.n_turns, row.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (row.loss_chars, row.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert not got


def test_parts_of_long_conversations(spark, monkeypatch):
    long = "word [INST] " * 200_000
    rows = [(5, i, "user" if i % 2 == 0 else "assistant", f"{i} </s>") for i in range(9000)] + [(6, 0, "user", long), (6, 1, "assistant", long), (7, 0, "assistant", "a"), (7, 1, "tool", "b")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        formatted = format_chats(frame(spark, rows))
        assert restored(formatted) == expected(rows)
        assert formatted.where("conv_id = 7").count() == 1 and formatted.where("conv_id = 5").count() <= 6
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_small_slices_make_the_same_whole():
    rows = random_rows()
    table = pa.table({"role": [r[2] or "" for r in rows], "text": [r[3] or "" for r in rows]})
    kept = chat_format.chunks
    try:
        chat_format.chunks = lambda offsets, limit=40: kept(offsets, limit)
        out, mask, ends = chat_format.assemble(table["role"].combine_chunks(), table["text"].combine_chunks())
    finally:
        chat_format.chunks = kept
    again, mask2, ends2 = chat_format.assemble(table["role"].combine_chunks(), table["text"].combine_chunks())
    assert out.tobytes() == again.tobytes() and mask.tobytes() == mask2.tobytes() and (ends == ends2).all()


def test_ties_repeats_and_empty(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "z"), (1, 0, "user", "a")]
    ((turns, _),) = restored(format_chats(frame(spark, rows))).values()
    assert turns[0] == ("assistant", "z") and sorted(turns[1:]) == [("user", "a"), ("user", "a"), ("user", "b")]
    assert format_chats(frame(spark, rows).limit(0)).count() == 0
    assert digests(format_chats(frame(spark, rows).limit(0))).count() == 0


def test_marked_conversation_of_the_query(spark):
    row = QUERIES["op13_chat_format"](spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest() and row.loss_chars == len(text)
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert row.formatted_chars == 2 * (len(text) + 3) + 7 + 8 + 3 + 4
