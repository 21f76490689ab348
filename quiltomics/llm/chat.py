"""Chat formatting with minimum-cost role repair.

A conversation is legal when it may open with one system turn, then user and assistant turns
alternate, starting with the user and ending with the assistant.  A dynamic program over the automaton of legal turns
chooses for every source turn whether it is kept, merged into the turn before it, given another role,
and where empty turns are inserted, at the least total cost (ties: the first of the named choices).

The cost of a stretch of turns, for every state before and every state after it, is a small matrix, and
matrices of consecutive stretches compose (minimum of sums).  A conversation of any length is therefore
cut into stretches of ``STRETCH`` turns: each task reduces its stretch to a matrix, a task per
conversation composes only the matrices of its stretches, and each stretch is then traced back between
its known end states.  No group ever holds a whole long conversation.

The result has one row per rendered turn or inserted turn; the texts of a conversation, concatenated in order of
``position``, are the rendered conversation.

Defined cases: a null or unknown role may take any role for the cost of a relabel (system only at the
start); null texts render as empty; repeated rows are turns each (order: turn, role, text); a null turn
number comes first; an empty table gives no rows; rows without a conversation id form one conversation;
other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiltomics.session import settled

STRETCH = 512
ROLES = ("system", "user", "assistant")
#: Costs: merging a turn into the one before, changing a role, inserting an empty turn.
MERGE, RELABEL, INSERT = 1, 3, 2
_BEGIN, _SYSTEM, _USER, _ASSISTANT = range(4)
_STATES = 4
_FAR = 1 << 40


@dataclass(frozen=True)
class Move:
    """One way to read a source turn: state after it, cost, action, role, role of an empty turn put before it."""

    after: int
    cost: int
    action: str
    role: str
    inserted: str | None


def _moves(state: int, role: str | None) -> list[Move]:
    """Legal moves from a state for a turn of this role, cheap ones first."""
    found = []
    if state != _BEGIN:
        same = ROLES[state - 1]
        # The turn joins the one before it, which it must agree with, else it is relabelled as well.
        found.append(Move(state, MERGE + (0 if role == same else RELABEL), "merge", same, None))
    for after, name in ((_SYSTEM, "system"), (_USER, "user"), (_ASSISTANT, "assistant")):
        change = 0 if role == name else RELABEL
        action = "keep" if role == name else "relabel"
        if after == _SYSTEM:
            if state == _BEGIN:
                found.append(Move(after, change, action, name, None))
        elif after == _USER:
            if state != _USER:
                found.append(Move(after, change, action, name, None))
            else:
                found.append(Move(after, change + INSERT, action, name, "assistant"))
        elif state == _USER:
            found.append(Move(after, change, action, name, None))
        else:
            found.append(Move(after, change + INSERT, action, name, "user"))
    return sorted(found, key=lambda m: m.cost)


_TABLE = {(s, r): _moves(s, r) for s in range(_STATES) for r in (*ROLES, None)}


def _known(role: str | None) -> str | None:
    return role if role in ROLES else None


def stretch_costs(roles: list[str | None]) -> np.ndarray:
    """Least cost of reading the turns, from every state (row) to every state (column)."""
    costs = np.full((_STATES, _STATES), _FAR, np.int64)
    for first in range(_STATES):
        line = [_FAR] * _STATES
        line[first] = 0
        for role in roles:
            after = [_FAR] * _STATES
            for state, cost in enumerate(line):
                if cost < _FAR:
                    for move in _TABLE[state, _known(role)]:
                        after[move.after] = min(after[move.after], cost + move.cost)
            line = after
        costs[first] = line
    return costs


def trace(roles: list[str | None], first: int, last: int) -> list[Move]:
    """The cheapest moves from state ``first`` to state ``last``."""
    lines, line = [], [_FAR] * _STATES
    line[first] = 0
    for role in roles:
        after: list[int] = [_FAR] * _STATES
        back: list[tuple[int, Move] | None] = [None] * _STATES
        for state, cost in enumerate(line):
            if cost < _FAR:
                for move in _TABLE[state, _known(role)]:
                    if cost + move.cost < after[move.after]:
                        after[move.after] = cost + move.cost
                        back[move.after] = (state, move)
        lines.append(back)
        line = after
    moves, state = [], last
    for back in reversed(lines):
        state, move = back[state]
        moves.append(move)
    return moves[::-1]


def _ending(state: int) -> int:
    """Cost of the empty turns after the last source turn."""
    return {_USER: INSERT, _SYSTEM: 2 * INSERT}.get(state, 0)


def join_stretches(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """State before and after every stretch on the cheapest way through the conversation."""
    line = np.full(_STATES, _FAR, np.int64)
    line[_BEGIN] = 0
    choices = []
    for matrix in matrices:
        sums = line[:, None] + matrix
        choices.append(sums.argmin(axis=0))
        line = np.minimum(sums.min(axis=0), _FAR)
    state = int(np.argmin([c + _ending(s) for s, c in enumerate(line.tolist())]))
    ends = []
    for choice in reversed(choices):
        before = int(choice[state])
        ends.append((before, state))
        state = before
    return ends[::-1]


def _render(role: str, text: str, opens: bool) -> str:
    return f"<|{role}|>\n{text}" if opens else f"\n{text}"


def repair(turns: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``conv_id, position, turn, role, action, rendered`` for turns ``conv_id, turn, role, text``."""
    numbered = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    # Turn numbers place a turn in a slice of numbers; only slice counts are accumulated per conversation.
    numbered = numbered.withColumn("_slice", F.coalesce(F.floor(F.col("turn") / stretch), F.lit(-1 << 40)))
    counts = numbered.groupBy("conv_id", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("conv_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    same = F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("l._slice") == F.col("r._slice"))
    inside = Window.partitionBy("conv_id", "_slice").orderBy("turn", F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    placed = (
        numbered.alias("l")
        .join(counts.alias("r"), same)
        .select("l.*", "r._first")
        .withColumn("_row", F.col("_first") + F.row_number().over(inside) - 1)
        .select("conv_id", "turn", "role", "text", "_row", F.floor(F.col("_row") / stretch).alias("_stretch"))
    )
    placed = settled(placed, "turns")
    # Every task takes many stretches of at most ``stretch`` turns, about 4,096 turns in all.
    groups = 1 + placed.count() // 4096
    stretch_group = F.pmod(F.xxhash64("conv_id", "_stretch"), F.lit(groups)).alias("_group")
    conversation_group = F.pmod(F.xxhash64("conv_id"), F.lit(groups)).alias("_group")

    def stretches(group: pa.Table) -> Iterator[tuple[tuple, list[dict]]]:
        rows = group.to_pylist()
        rows.sort(key=lambda r: (r["conv_id"] is not None, r["conv_id"] or 0, r["_stretch"], r.get("_row", 0)))
        return ((k, list(v)) for k, v in itertools.groupby(rows, key=lambda r: (r["conv_id"], r["_stretch"])))

    def reduce(group: pa.Table) -> pa.Table:
        out = [(c, s, stretch_costs([r["role"] for r in rows]).ravel().tolist()) for (c, s), rows in stretches(group)]
        return _arrow(out, conv_id=pa.int64(), _stretch=pa.int64(), costs=pa.list_(pa.int64()))

    def join(group: pa.Table) -> pa.Table:
        out = []
        for conv, rows in itertools.groupby(stretches(group), key=lambda item: item[0][0]):
            parts = [row for _, members in rows for row in members]
            ends = join_stretches([np.array(r["costs"], np.int64).reshape(_STATES, _STATES) for r in parts])
            for row, (first, last) in zip(parts, ends):
                out.append((conv, row["_stretch"], first, last, row is parts[-1]))
        return _arrow(out, conv_id=pa.int64(), _stretch=pa.int64(), first=pa.int32(), last=pa.int32(), final=pa.bool_())

    def rewrite(group: pa.Table) -> pa.Table:
        out = []
        for (conv, _), rows in stretches(group):
            last = rows[0]["last"]
            for row, move in zip(rows, trace([r["role"] for r in rows], rows[0]["first"], last)):
                place = 4 * row["_row"]
                if move.inserted:
                    out.append((conv, place, None, move.inserted, "insert", _render(move.inserted, "", True)))
                shown = _render(move.role, row["text"] or "", move.action != "merge")
                out.append((conv, place + 1, row["turn"], move.role, move.action, shown))
            if rows[0]["final"]:
                for extra, role in enumerate({_USER: ("assistant",), _SYSTEM: ("user", "assistant")}.get(last, ())):
                    place = 4 * rows[-1]["_row"] + 2 + extra
                    out.append((conv, place, None, role, "insert", _render(role, "", True)))
        return _arrow(
            out, conv_id=pa.int64(), position=pa.int64(), turn=pa.int64(), role=pa.string(), action=pa.string(), rendered=pa.string()
        )

    matrices = placed.select(stretch_group, "conv_id", "_stretch", "_row", "role").groupBy("_group").applyInArrow(
        reduce, "conv_id long, _stretch long, costs array<long>"
    )
    # One row per stretch: a conversation's turns divided by ``stretch``.
    ends = matrices.select(conversation_group, "*").groupBy("_group").applyInArrow(
        join, "conv_id long, _stretch long, first int, last int, final boolean"
    )
    match = F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("l._stretch") == F.col("r._stretch"))
    joined = placed.alias("l").join(ends.alias("r"), match).select("l.*", "r.first", "r.last", "r.final")
    return joined.select(stretch_group, "*").groupBy("_group").applyInArrow(
        rewrite, "conv_id long, position long, turn long, role string, action string, rendered string"
    )


def _arrow(rows: list[tuple], **columns: pa.DataType) -> pa.Table:
    parts = zip(*rows) if rows else [()] * len(columns)
    return pa.table({name: pa.array(part, kind) for (name, kind), part in zip(columns.items(), parts)})
