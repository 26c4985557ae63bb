"""Repair of the turn structure of conversations: a backward cost-to-go and a greedy forward walk.

The roles of a repaired conversation form `(s?(ua)+)?`: maybe a system turn,
then pairs of user and assistant, or nothing. A state says which turn came last.
For each row, from the last to the first, the least cost of all that follows is
known for every state; less their smallest entry these vectors take few values,
so a row is a lookup. The walk from the first row then takes, of the edits
that stay on a cheapest way, the first in ASCII order.

A conversation's rows reach its task twice in a row of one sorted stream: first
as codes of a few bytes, which the costs need, then as texts, which are hashed
as they pass. So texts aren't gathered; a conversation holds about 40 bytes a
row in its task, and its repaired text is hashed in order, as the digest asks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space; costs of the edits; what an undeleted truncated row adds.
BLANKS = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3

#: States by what came last: nothing, system, user, assistant. An inserted or re-roled turn leads to FORCED[state].
START, SYSTEM, USER, ASSISTANT = range(4)
FORCED = (USER, USER, ASSISTANT, USER)
ROLE = {USER: b"user", ASSISTANT: b"assistant"}
#: KEPT[state] by the role's initial (s, u, a, other): the state that keeping the row leads to.
KEPT = ((SYSTEM, USER, None, None), (None, USER, None, None), (None, None, ASSISTANT, None), (None, USER, None, None))
INITIALS = "sua"
CLEAN, CUT, GONE = range(3)
#: Cost and edits from a state after the last row.
END = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))


class Costs:
    """Cost vectors by number and what each row code makes of them."""

    def __init__(self):
        self.vectors, self.numbers, self.steps = [], {}, {}
        self.end = self._number(tuple(cost for cost, _ in END))

    def _number(self, vector: tuple) -> int:
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.numbers[vector]

    def step(self, after: int, code: int) -> tuple[int, int, tuple]:
        """(number of the vector before a row, cost taken out of it, (edits, next state) by state)."""
        key = (after, code)
        if key not in self.steps:
            self.steps[key] = self._step(self.vectors[after], *divmod(code, 3))
        return self.steps[key]

    def _step(self, after: tuple, initial: int, fault: int):
        extra, choices = TRUNCATED * (fault == CUT), []
        for state in range(4):
            ways = [("D", DELETE + after[state], state)]
            if fault != GONE:
                if (kept := KEPT[state][initial]) is not None:
                    ways.append(("K", extra + after[kept], kept))
                ways.append(("R", REROLE + extra + after[FORCED[state]], FORCED[state]))
            choices.append(ways)
        best = [min(cost for _, cost, _ in ways) for ways in choices]
        cost = [min(best[s], INSERT + best[FORCED[s]], 2 * INSERT + best[FORCED[FORCED[s]]]) for s in range(4)]
        walk = []
        for state in range(4):
            edits = ""
            while True:
                tight = {edit: to for edit, c, to in choices[state] if c == cost[state]}
                if cost[FORCED[state]] + INSERT == cost[state]:
                    tight["I"] = FORCED[state]
                edit = min(tight)
                edits += edit
                state = tight[edit]
                if edit != "I":
                    break
            walk.append((edits, state))
        least = min(cost)
        return self._number(tuple(c - least for c in cost)), least, tuple(walk)


def plan(codes: bytes, costs: Costs) -> tuple[int, list[tuple[str, int]]]:
    """(least cost, for each row its edits and the state before them, with one more entry for the end) of a conversation's row codes."""
    after, total, walks = costs.end, 0, []
    for code in reversed(codes):
        after, least, walk = costs.step(after, code)
        total += least
        walks.append(walk)
    total += costs.vectors[after][START]
    state, ways = START, []
    for walk in reversed(walks):
        edits, to = walk[state]
        ways.append((edits, state))
        state = to
    ways.append((END[state][1], state))
    return total, ways


def rebuilt(edits: str, state: int, role: bytes, text: bytes):
    """The turns `role:text` that a row's edits leave, from the state before them."""
    for edit in edits:
        if edit == "K":
            yield role + b":" + text
        elif edit in "IR":
            state = FORCED[state]
            yield ROLE[state] + b":" + (text if edit == "R" else b"")


class Conversation:
    """What one conversation has shown of itself so far."""

    def __init__(self, conv_id, costs: Costs):
        self.conv_id, self.costs, self.parts, self.ways = conv_id, costs, [], None
        self.at, self.sha, self.turns = 0, hashlib.sha256(), 0

    def rows(self, codes: dict[str, np.ndarray]) -> None:
        self.parts.append(codes)

    def _decide(self) -> None:
        joined = {name: np.concatenate([p[name] for p in self.parts]) for name in self.parts[0]}
        self.parts = None
        there = joined["code"] >= 0
        joined = {name: values[there] for name, values in joined.items()}
        n, code = int(there.sum()), joined["code"]
        blank = code % 3 == GONE
        keys = np.rec.fromarrays([joined["h1"], joined["h2"]])
        first = np.zeros(n, bool)
        first[np.unique(keys, return_index=True)[1]] = True
        duplicate = ~blank & ~first
        initial = code // 3
        pairs = initial[:-1] * 4 + initial[1:]
        turns = joined["turn"][~joined["no_turn"]]
        gaps = int(turns[-1]) - int(turns[0]) + 1 - (1 + int((turns[1:] != turns[:-1]).sum())) if len(turns) else 0
        fault = np.where(duplicate, GONE, code % 3)
        cost, self.ways = plan((initial * 3 + fault).astype(np.uint8).tobytes(), self.costs)
        self.found = (min(gaps, 2**63 - 1), int(blank.sum()), int(duplicate.sum()), int((fault == CUT).sum()), int((~np.isin(pairs, (1, 6, 9))).sum()), cost)

    def _turns(self, edits: str, state: int, role: bytes, text: bytes) -> None:
        for turn in rebuilt(edits, state, role, text):
            self.sha.update(b"\n" + turn if self.turns else turn)
            self.turns += 1

    def texts(self, roles: list, texts: list) -> None:
        if self.ways is None:
            self._decide()
        for role, text in zip(roles, texts):
            self._turns(*self.ways[self.at], role, text)
            self.at += 1

    def close(self) -> tuple:
        if self.ways is None:
            self._decide()
        self._turns(*self.ways[-1], b"", b"")
        return (self.conv_id, *self.found, "".join(edits for edits, _ in self.ways), self.sha.hexdigest())


OUTPUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ARROW = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in OUTPUT.split(", ")])
ROWS_OUT = 4096


def _repair(batches):
    """Conversations of a sorted stream of codes and texts, one result each."""
    costs, now, out = Costs(), None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, known = pc.fill_null(batch["conv_id"], 0).to_numpy(zero_copy_only=False), pc.is_valid(batch["conv_id"]).to_numpy(zero_copy_only=False)
        kind = batch["kind"].to_numpy()
        cuts = np.flatnonzero((ids[1:] != ids[:-1]) | (known[1:] != known[:-1]) | (kind[1:] != kind[:-1])) + 1
        numbers = {c: batch[c].to_numpy(zero_copy_only=False) for c in ("code", "h1", "h2")}
        numbers |= {"turn": pc.fill_null(batch["turn"], 0).to_numpy(zero_copy_only=False), "no_turn": pc.is_null(batch["turn"]).to_numpy(zero_copy_only=False)}
        roles, texts = batch["role"].cast(pa.binary()).to_pylist(), batch["text"].cast(pa.large_binary()).to_pylist()
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            conv = int(ids[a]) if known[a] else None
            if now is None or now.conv_id != conv:
                if now is not None:
                    out.append(now.close())
                now = Conversation(conv, costs)
            if kind[a] == 0:
                now.rows({name: values[a:b] for name, values in numbers.items()})
            else:
                now.texts(roles[a:b], texts[a:b])
        if len(out) >= ROWS_OUT:
            yield _as_batch(out)
            out = []
    if now is not None:
        out.append(now.close())
    if out:
        yield _as_batch(out)


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*rows), ARROW.types)], schema=ARROW)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped) after the damage that each row's `conv_id:turn` decides; what is dropped stays marked."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), blank("role").alias("role"), blank("text").alias("text"), (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20).alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("fate") == 0).alias("dropped"), copies.alias("copy")).drop("copy")


def row_code(role: Column, text: Column) -> Column:
    """3 x the role's initial (place in INITIALS, else 3) + the row's own fault: blank, truncated or none."""
    bare = F.rtrim(text, F.lit(BLANKS))
    initial = F.instr(F.lit(INITIALS), F.substring(role, 1, 1))
    fault = F.when(bare == "", GONE).when(F.substring(bare, -1, 1).isin(".", "!", "?"), CLEAN).otherwise(CUT)
    return (3 * F.when((initial == 0) | (role == ""), len(INITIALS)).otherwise(initial - 1) + fault).cast("int")


def repair_turns(rows: DataFrame) -> DataFrame:
    """Faults and the cheapest repair of each conversation of `rows` (conv_id, turn, role, text, dropped).

    Rows go by turn, nulls first, those of one turn by role and then by hashes of
    the text. A row's first fault counts: blank, duplicate of an earlier row's role
    and text, truncated. Null roles and texts count as one space; a null conv_id is
    a conversation of its own; rows marked `dropped` only name their conversation.
    Repeated rows are duplicates; other columns are ignored; an empty table gives
    none. Gaps beyond a long are given as the largest long.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), "dropped")
    rows = rows.select("*", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("t"), "text").alias("t2"), F.xxhash64("role", "text").alias("h1"), F.xxhash64("text", "role").alias("h2"), F.when(F.col("dropped"), -1).otherwise(row_code(F.col("role"), F.col("text"))).alias("code"))
    twice = F.explode(F.when(F.col("dropped"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("kind")
    rows = rows.select("*", twice).withColumn("text", F.when(F.col("kind") == 1, F.col("text")))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "t1", "t2")
    return ordered.select("conv_id", "kind", "turn", "role", "text", "h1", "h2", "code").mapInArrow(_repair, OUTPUT)


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The repair of `conversations` after the damage of `damaged`: one row for each conv_id, also where no row is left."""
    return repair_turns(damaged(conversations))
