"""Chat formatting by role repair of minimum cost.

A conversation is legal when an optional system turn comes first, user and assistant turns alternate after it, and the
assistant speaks last. Each turn is kept, given another role, or merged into the turn before, and empty turns may be
put between turns or at the end. The costs below make one repair the cheapest, found by dynamic programming over the
automaton's states (the role spoken last); ties go to the first state in order. The result is rendered row by row:
joined in the order of `seq`, the fragments of a conversation are its text in the chat template.

Conversations of any length are repaired in parallel. Turns are range partitioned by conversation and turn; the piece of
a conversation in a partition gives a table of the cheapest way from each state to each other, the tables of a
conversation (one per partition at most) fix the states between pieces, and each piece is then repaired on its own.

Turns go by `turn`, nulls last, then by role and text. A null text is empty, a null or unknown role is nobody's and
cheaper to relabel, null conv_ids form one conversation, repeated rows are turns of their own.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlemill.llm.scratch import Scratch

# Roles by state, other names of roles, costs, and the marks of the chat template.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ["", "system", "user", "assistant"]
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}
RELABEL, RELABEL_UNKNOWN, MERGE, INSERT = 8, 1, 2, 5
OPEN, CLOSE = "<|%s|>\n", "<|end|>\n"
NEVER = 1 << 40

LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


def _between(p: int, q: int) -> list[int] | None:
    """The fewest empty turns that make q legal after p."""
    if (p, q) in LEGAL:
        return []
    if q in (START, SYSTEM):
        return None
    if q == p:
        return [ASSISTANT if q == USER else USER]
    return [USER]  # an assistant turn at the start or after the system turn


def _steps() -> tuple[np.ndarray, dict[tuple[int, int], tuple[int, list[int]]]]:
    """Cost of speaking as q after p, and how: (1 for a merge, empty turns before)."""
    cost, how = np.full((4, 4), NEVER, np.int64), {}
    for p in range(4):
        for q in (SYSTEM, USER, ASSISTANT):
            ways = [(MERGE, (1, []))] if p == q else []
            empty = _between(p, q)
            if empty is not None:
                ways.append((INSERT * len(empty), (0, empty)))
            if ways:
                cost[p, q], how[p, q] = min(ways, key=lambda w: w[0])
    return cost, how


STEP_COST, STEP_HOW = _steps()
#: By the role a turn has (START for an unknown one): cost of each step.
TURN_COST = np.stack([STEP_COST + np.array([NEVER, *(0 if o == q else RELABEL_UNKNOWN if o == START else RELABEL for q in (1, 2, 3))])[None, :] for o in range(4)])
END_EMPTY = {START: [], SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT], ASSISTANT: []}
END_COST = np.array([INSERT * len(END_EMPTY[s]) for s in range(4)])


def ways(codes: list[int]) -> np.ndarray:
    """The least cost from each state before some turns to each state after them."""
    total = np.where(np.eye(4, dtype=bool), 0, NEVER)
    for code in codes:
        total = np.minimum((total[:, :, None] + TURN_COST[code][None]).min(1), NEVER)
    return total


def repair(codes: list[int], before: int, after: int) -> list[int]:
    """The states after each turn on the cheapest way from one state to another."""
    value = np.full(4, NEVER)
    value[before] = 0
    source = np.zeros((len(codes), 4), np.int8)
    for t, code in enumerate(codes):
        all_ways = value[:, None] + TURN_COST[code]
        source[t] = all_ways.argmin(0)
        value = np.minimum(all_ways.min(0), NEVER)
    path = [after]
    for t in range(len(codes) - 1, 0, -1):
        path.append(int(source[t, path[-1]]))
    return path[::-1]


def _pieces(batches):
    """(part, conv, rows) of consecutive turns of a conversation, across batches."""

    def rows():
        for batch in batches:
            yield from batch.to_pylist()

    yield from groupby(rows(), key=lambda r: (r["part"], r["conv_id"]))


def _tables(batches):
    for (part, conv), rows in _pieces(batches):
        codes = [r["code"] for r in rows]
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "conv_id": pa.array([conv], pa.int64()), "n": [len(codes)], "ways": pa.array([ways(codes).ravel().tolist()], pa.list_(pa.int64()))})


def _fix_states(batches):
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            value, tables = np.array([0, NEVER, NEVER, NEVER]), sorted(row["tables"], key=lambda t: t["part"])
            values = []
            for table in tables:
                values.append(value)
                value = np.minimum((value[:, None] + np.array(table["ways"]).reshape(4, 4)).min(0), NEVER)
            state = int((value + END_COST).argmin())
            after = len(tables) and sum(t["n"] for t in tables)
            for i in range(len(tables) - 1, -1, -1):
                before = int((values[i] + np.array(tables[i]["ways"]).reshape(4, 4)[:, state]).argmin())
                after -= tables[i]["n"]
                out.append({"part": tables[i]["part"], "conv_id": row["conv_id"], "enters": before, "leaves": state, "start": after, "last": i == len(tables) - 1})
                state = before
        if out:
            yield pa.RecordBatch.from_pylist(out, pa.schema([("part", pa.int32()), ("conv_id", pa.int64()), ("enters", pa.int32()), ("leaves", pa.int32()), ("start", pa.int64()), ("last", pa.bool_())]))


DECISION = "pos long, conv_id long, seq long, new_role string, action string, inserted int, cost long, head string, tail string"


def _decide(batches):
    def flush(out):
        return pa.RecordBatch.from_pylist(out, pa.schema([("pos", pa.int64()), ("conv_id", pa.int64()), ("seq", pa.int64()), ("new_role", pa.string()), ("action", pa.string()), ("inserted", pa.int32()), ("cost", pa.int64()), ("head", pa.string()), ("tail", pa.string())]))

    out = []
    for (_, conv), rows in _pieces(batches):
        rows = list(rows)  # the narrow rows of one conversation within one range partition
        state = rows[0]["enters"]
        for i, (row, now) in enumerate(zip(rows, repair([r["code"] for r in rows], state, rows[0]["leaves"]), strict=True)):
            merged, empty = STEP_HOW[state, now]
            changed = row["code"] != now
            ends = END_EMPTY[now] if row["last"] and i == len(rows) - 1 else []
            head = "\n\n" if merged else (CLOSE if state != START else "") + "".join(OPEN % ROLES[e] + CLOSE for e in empty) + OPEN % ROLES[now]
            tail = CLOSE + "".join(OPEN % ROLES[e] + CLOSE for e in ends) if row["last"] and i == len(rows) - 1 else ""
            action = "merge" if merged else "keep"
            out.append({
                "pos": row["pos"], "conv_id": conv, "seq": row["start"] + i, "new_role": ROLES[now], "action": action + "+relabel" * changed, "inserted": len(empty) + len(ends),
                "cost": int(TURN_COST[row["code"]][state, now]) + INSERT * len(ends), "head": head, "tail": tail,
            })
            state = now
        if len(out) >= 2000:
            yield flush(out)
            out = []
    if out:
        yield flush(out)


def repair_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, seq, turn, role, new_role, action, inserted, cost, rendered): a row per turn.

    `inserted` counts empty turns before this one, and after it at the end. Marks within texts are broken up.
    """
    scratch = Scratch(turns.sparkSession)
    role = F.lower(F.trim(F.coalesce("role", F.lit(""))))
    for other, known in ALIASES.items():
        role = F.when(role == other, known).otherwise(role)
    code = F.coalesce(F.array_position(F.array(*[F.lit(r) for r in ROLES[1:]]), role), F.lit(0)).cast("int")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("role"), F.xxhash64("text"), F.col("text")]
    rows = rows.repartitionByRange(*order[:4]).sortWithinPartitions(*order)
    rows = scratch.keep(rows.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos"), "conv_id", "turn", "role", code.alias("code"), "text"), "turns")
    # A number of partitions that is asked for stays, however little is in each.
    tasks = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = rows.select("part", "pos", "conv_id", "code").repartition(tasks, "part").sortWithinPartitions("part", "pos")
    tables = narrow.mapInArrow(_tables, "part int, conv_id long, n long, ways array<long>")
    states = tables.groupBy("conv_id").agg(F.collect_list(F.struct("part", "n", "ways")).alias("tables"))
    states = scratch.keep(states.mapInArrow(_fix_states, "part int, conv_id long, enters int, leaves int, start long, last boolean"), "states")
    narrow = rows.select("part", "pos", "conv_id", "code").alias("r").join(states.alias("s"), (F.col("r.part") == F.col("s.part")) & F.col("r.conv_id").eqNullSafe(F.col("s.conv_id")))
    narrow = narrow.select("r.part", "r.pos", "r.conv_id", "r.code", "s.enters", "s.leaves", "s.start", "s.last").repartition(tasks, "part").sortWithinPartitions("part", "pos")
    decided = scratch.keep(narrow.mapInArrow(_decide, DECISION), "decided").drop("conv_id")
    shown = F.concat("head", F.replace(F.col("text"), F.lit("<|"), F.lit("< |")), "tail")
    return rows.join(decided, "pos").select("conv_id", "seq", "turn", "role", "new_role", "action", "inserted", "cost", shown.alias("rendered"))
