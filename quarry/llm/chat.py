"""Chat formatting with minimum-cost role repair.

A legal chat is an optional system turn, then user and assistant turns by turns, ending
with the assistant.  A turn may be kept, relabelled, or merged into the one before if that
has its role; empty turns may be inserted.  Dynamic programming over the automaton's states
(the role of the turn written last) finds the cheapest repair, and its turns are rendered.

A conversation is cut into chunks of turn numbers.  The least costs between the states at a
chunk's ends are a small matrix, and matrices compose, so the chunks of a long conversation
are worked out side by side: first the matrices, then the states at the cuts, then the
turns of each chunk.  Conversations of one chunk need neither matrices nor cuts.  A task
holds one chunk of turns at a time, or one matrix for each chunk of a conversation.

Turns go by number, then role and text; null numbers come first, and null texts are empty.
Numbers should tell turns apart: turns without one, or with numbers of one chunk however
often repeated, are one chunk.  Roles other than the three (null too) must be relabelled,
which costs less.  Of repairs with equal cost the one that merges latest, then keeps, wins.
Texts of any length are rendered whole.  ``<|`` in a text becomes ``<||``, so texts can't
forge turns, and replacing ``<||`` by ``<|`` gives them back.  Repeated rows are turns of
their own, null ids one conversation, and an empty table stays empty.  Other columns of the
input are not looked at, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quarry.llm.common import bounded_batches, written

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
MERGE, RELABEL, ADOPT, INSERT = 1, 3, 1, 2
INF = 1 << 40
#: For each state, the turns that may follow it.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}


def _gaps() -> dict[tuple[int, int], tuple[int, ...]]:
    """The shortest run of empty turns that makes a role legal after a state."""
    out = {}
    for s in range(4):
        for q in (SYSTEM, USER, ASSISTANT):
            paths = [(s, ())]
            for _ in range(3):
                hit = next((p for at, p in paths if q in NEXT[at]), None)
                if hit is not None:
                    out[s, q] = hit
                    break
                # A system turn is never made up.
                paths = [(x, (*p, x)) for at, p in paths for x in NEXT[at] if x != SYSTEM]
    return out


GAPS = _gaps()
#: Turns that close a chat from each state.
CLOSING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def steps(state: int, role: str | None) -> list[tuple[int, int, str]]:
    """(cost, next state, action) of the ways to write a turn after a state."""
    own = ROLES.index(role) if role in ROLES[1:] else None
    out = []
    if own is not None and own == state:
        out.append((MERGE, state, "merge"))
    for q in (SYSTEM, USER, ASSISTANT):
        if (state, q) in GAPS:
            change = 0 if q == own else ADOPT if own is None else RELABEL
            out.append((change + INSERT * len(GAPS[state, q]), q, "keep" if q == own else "relabel"))
    return out


def costs(roles: list[str | None]) -> list[list[int]]:
    """The least cost from each state to each over the turns."""
    table = [[0 if a == b else INF for b in range(4)] for a in range(4)]
    for r in roles:
        new = [[INF] * 4 for _ in range(4)]
        for s, c, q, _ in _ways(known(r)):
            for a in range(4):
                new[a][q] = min(new[a][q], table[a][s] + c)
        table = new
    return table


@lru_cache(maxsize=None)
def _ways(role: str | None) -> list[tuple[int, int, int, str]]:
    """(state, cost, next state, action) of all ways to write a turn of a role."""
    return [(s, *w) for s in range(4) for w in steps(s, role)]


def known(role: str | None) -> str | None:
    """role, or None for all that must be relabelled."""
    return role if role in ROLES[1:] else None


def repair(roles: list[str | None], entry: int, leave: int | None = None) -> list[tuple[str, int, int]]:
    """(action, state before, state after) of each turn on a cheapest way between states.

    Without ``leave`` the chat ends here, and the way with its closing turns is cheapest.
    """
    best = [INF] * 4
    best[entry] = 0
    back: list[list[tuple[int, str] | None]] = []
    for r in roles:
        row, ways = [INF] * 4, [None] * 4
        for s, c, q, action in _ways(known(r)):
            if best[s] + c < row[q]:
                row[q], ways[q] = best[s] + c, (s, action)
        best = row
        back.append(ways)
    at = min((c + INSERT * len(CLOSING[s]), s) for s, c in enumerate(best))[1] if leave is None else leave
    out = []
    for ways in reversed(back):
        s, action = ways[at]
        out.append((action, s, at))
        at = s
    return out[::-1]


@lru_cache(maxsize=1 << 14)
def _repaired(roles: tuple[str | None, ...], entry: int, leave: int | None) -> list[tuple[str, int, int]]:
    """``repair`` of short chats, which repeat a few patterns of roles."""
    return repair(list(roles), entry, leave)


def path_cost(path: list[tuple[str, int, int]], roles: list[str | None]) -> int:
    """What a path's turns cost."""
    return sum(min(c for s, c, q, a in _ways(known(r)) if (a, s, q) == p) for p, r in zip(path, roles, strict=True))


def through(matrices: list[list[list[int]]]) -> tuple[list[int], int]:
    """States at the cuts of a cheapest chat through chunks, and its cost."""
    best, back = [0, INF, INF, INF], []
    for m in matrices:
        row = [min((best[s] + m[s][q], s) for s in range(4)) for q in range(4)]
        best = [c for c, _ in row]
        back.append([s for _, s in row])
    total, at = min((best[s] + INSERT * len(CLOSING[s]), s) for s in range(4))
    states = [at]
    for ways in reversed(back):
        states.append(ways[states[-1]])
    return states[::-1], total


def head(role: int) -> str:
    return f"<|{ROLES[role]}|>\n"


END = "<|end|>\n"


def escaped(text: str | None) -> str:
    """text without anything that reads as the start of a control token."""
    return (text or "").replace("<|", "<||")


def render(action: str, before: int, after: int, text: str | None) -> str:
    """What a turn adds to the rendered chat; each turn but a merged one first ends the last."""
    if action == "merge":
        return "\n\n" + escaped(text)
    made = "".join(head(q) + END for q in GAPS[before, after])
    return (END if before != START else "") + made + head(after) + escaped(text)


#: A conversation's name in groupings, where null is a name of its own, and its part.
NAME = ("__none", "__name")
#: The chunk of turns without a number.
NO_NUMBER = -(1 << 62)


def _by_chunk(rows: DataFrame, body: Callable[[dict[str, list]], dict[str, list]], schema: str, order: list[Column], most: int = 4096) -> DataFrame:
    """body for each (conversation, chunk) of rows, from and to columns, in sorted partitions.

    A partition streams: one chunk and about ``most`` rows of results are held at a time.
    """
    made = StructType.fromDDL(schema)
    kinds = to_arrow_schema(made)
    names = rows.columns
    key = [names.index(c) for c in (*NAME, "chunk")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: dict[str, list] = {f.name: [] for f in made}

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(out[k.name], k.type) for k in kinds], schema=kinds)

        def close() -> None:
            if held:
                for name, values in body(dict(zip(names, map(list, zip(*held, strict=True)), strict=True))).items():
                    out[name] += values
                held.clear()

        at = None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                now = tuple(row[k] for k in key)
                if now != at:
                    close()
                    at = now
                    if len(out[made[0].name]) >= most:
                        yield batch()
                        for v in out.values():
                            v.clear()
                held.append(row)
        close()
        yield batch()

    bounded_batches(rows.sparkSession)
    by = [*NAME, "chunk"]
    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, made)


def format_chats(chats: DataFrame, chunk: int = 1024) -> DataFrame:
    """A row for each turn: conv_id, turn, position, action, role, inserted, closing, segment, cost.

    segment is what the turn adds to the rendered conversation; the segments by
    (turn, position) joined are the conversation.  inserted has the roles of empty turns
    put before it, and closing those put after the last turn.  cost is the conversation's.
    """
    ids = chats.schema["conv_id"].dataType.simpleString()
    turn = F.col("turn").cast("long")
    rows = chats.select(
        "conv_id", turn.alias("turn"), "role", "text", F.coalesce(F.floor(turn / chunk), F.lit(NO_NUMBER)).alias("chunk"),
        F.col("conv_id").isNull().alias(NAME[0]), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias(NAME[1]),
    )
    roles_order = [F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit(""))]
    # Only conversations of several chunks have cuts.
    long = rows.groupBy(*NAME).agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).filter("a < b").select(*NAME)

    def matrix(part: dict[str, list]) -> dict[str, list]:
        flat = [c for row in costs(part["role"]) for c in row]
        return {k: part[k][:1] for k in (*NAME, "chunk")} | {"m": [flat]}

    # Roles decide, so texts stay where they are.
    narrow = rows.select(*NAME, "chunk", "turn", "role").join(long, list(NAME), "left_semi")
    matrices = _by_chunk(narrow, matrix, f"{NAME[0]} boolean, {NAME[1]} string, chunk long, m array<long>", roles_order)

    def cuts(table: pa.Table) -> pa.Table:
        chunks = table.column("chunk").to_pylist()
        turn = sorted(range(len(chunks)), key=chunks.__getitem__)
        flat = table.column("m").to_pylist()
        states, total = through([[flat[i][4 * a : 4 * a + 4] for a in range(4)] for i in turn])
        n = len(turn)
        return pa.table(
            {c: table.column(c).take(pa.array(turn)) for c in (*NAME, "chunk")}
            | {
                "entry": pa.array(states[:-1], pa.int32()),
                "leave": pa.array(states[1:], pa.int32()),
                "ends": pa.array([i == n - 1 for i in range(n)]),
                "cost": pa.array([total] * n, pa.int64()),
            }
        )

    found = matrices.groupBy(*NAME).applyInArrow(cuts, f"{NAME[0]} boolean, {NAME[1]} string, chunk long, entry int, leave int, ends boolean, cost long")
    joined = rows.join(written(found), [*NAME, "chunk"], "left")

    def turns(part: dict[str, list]) -> dict[str, list]:
        roles = [known(r) for r in part["role"]]
        n = len(roles)
        entry, leave, ends, cost = (part[c][0] for c in ("entry", "leave", "ends", "cost"))
        alone = entry is None
        way = _repaired if n <= 64 else repair
        path = way(tuple(roles), START if alone else entry, leave)
        segments = [render(*p, x) for p, x in zip(path, part["text"], strict=True)]
        closing: list[list[str]] = [[]] * n
        if alone:
            cost = path_cost(path, roles) + INSERT * len(CLOSING[path[-1][2]])
        if alone or ends:
            rest = CLOSING[path[-1][2]]
            segments[-1] += END + "".join(head(q) + END for q in rest)
            closing = [*closing[:-1], [ROLES[q] for q in rest]]
        return {
            "conv_id": part["conv_id"],
            "turn": part["turn"],
            "position": list(range(n)),
            "action": [a for a, _, _ in path],
            "role": [ROLES[q] for _, _, q in path],
            "inserted": [[] if a == "merge" else [ROLES[x] for x in GAPS[s, q]] for a, s, q in path],
            "closing": closing,
            "segment": segments,
            "cost": [cost] * n,
        }

    return _by_chunk(
        joined, turns,
        f"conv_id {ids}, turn long, position long, action string, role string, inserted array<string>, closing array<string>, segment string, cost long",
        [*roles_order, F.coalesce("text", F.lit(""))],
    )
