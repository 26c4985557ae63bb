"""Repair of conversations against a plain search over all edits."""

import functools
import hashlib
import random
import re
import zlib

from rillflow.llm.turn_repair import repair_damaged, repair_turns

SCHEMA = "conv_id long, turn long, role string, text string, kind int, code string, copy string, h1 string, n long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "c", "x", "h", 2) for r in rows], SCHEMA)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def repaired(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, hash) of one conversation's rows, by trying all edits."""
    faults, seen = [], set()
    for _, _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    @functools.lru_cache(None)
    def best(i, last, inserted):
        """The cheapest (cost, audit, turns) from row i on, where `last` is the initial of the turn before."""
        ways = []
        if i == len(rows):
            if last in ("", "a"):
                ways.append((0, "", ()))
        else:
            _, _, role, text = rows[i]
            c, a, t = best(i + 1, last, 0)
            ways.append((c + 4, "D" + a, t))
            if faults[i] in ("", "truncated"):
                more = 3 * (faults[i] == "truncated")
                if (last, role[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    c, a, t = best(i + 1, role[:1], 0)
                    ways.append((c + more, "K" + a, (f"{role}:{text}", *t)))
                to = "assistant" if last == "u" else "user"
                c, a, t = best(i + 1, to[0], 0)
                ways.append((c + 3 + more, "R" + a, (f"{to}:{text}", *t)))
        if inserted < 3:
            to = "assistant" if last == "u" else "user"
            c, a, t = best(i, to[0], inserted + 1)
            ways.append((c + 3, "I" + a, (f"{to}:", *t)))
        return min(ways, default=(10**9, "", ()))

    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, made = best(0, "", 0)
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()


def check(spark, rows, operator, after):
    got = {tuple(r)[0]: tuple(r)[1:] for r in operator(frame(spark, rows)).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, found in got.items():
        own = sorted((r for r in after(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        assert found == repaired(own), (conv, own)


def test_against_all_edits(spark):
    rng, rows = random.Random(7), []
    for conv in range(150):
        for turn in range(rng.randrange(0, 8)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", "User", "unknown", None])
            text = rng.choice(["Yes.", "No!", "open end", "a.b", " \t\n", "", None, "é?", "tail. \n", "…", "same.", "same.", "x" * 3000 + "."])
            rows.append((conv, turn * rng.choice([1, 1, 2]) + rng.randrange(2) * 1000, role, text))
    rows = list({(r[0], r[1]): r for r in rows}.values())  # a turn once: ties are tested apart
    check(spark, rows, repair_damaged, damage)


def test_nulls_ties_and_repeats(spark):
    rows = [(None, None, "user", "Hi."), (None, 1, "assistant", "Yes."), (1, None, "user", "One."), (1, None, "user", "One."), (1, 2, "assistant", "Two."), (2, 5, None, None), (3, 0, "user", "Same."), (3, 0, "user", "Same."), (3, 1, "assistant", "Ok."), (4, -(2**63), "user", "Far."), (4, 2**63 - 1, "assistant", "Away.")]
    marked = lambda df: repair_turns(df.selectExpr("*", "false AS dropped"))
    after = lambda rows: [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c != 4]
    check(spark, [r for r in rows if r[0] != 4], marked, after)
    far = marked(frame(spark, [r for r in rows if r[0] == 4])).first()
    assert (far.gaps, far.cost, far.audit) == (2**63 - 1, 0, "KK")


def test_all_rows_dropped_and_empty_table(spark):
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    (row,) = repair_damaged(frame(spark, [(lost, 0, "user", "Gone.")])).collect()
    assert tuple(row) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair_damaged(frame(spark, [(1, 1, "user", "x")]).limit(0)).count() == 0


def test_long_conversation_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        rows = [(9, i, "user" if i % 2 == 0 else "assistant", f"Turn {i}.") for i in range(700)] + [(10, 0, "user", "Q?"), (10, 1, "assistant", "A.")]
        got = {r.conv_id: r for r in repair_turns(frame(spark, rows).selectExpr("*", "false AS dropped")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[9].audit == "K" * 700 and got[9].cost == 0 and got[10].audit == "KK"
    assert got[9].repaired_sha256 == hashlib.sha256("\n".join(f"{r[2]}:{r[3]}" for r in rows[:700]).encode()).hexdigest()
