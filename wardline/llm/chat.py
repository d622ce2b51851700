"""Chat formatting by minimum-cost role repair.

Legal conversations run through an automaton: an optional system turn, then user and
assistant in turns, ending with the assistant. Each source turn is kept, relabelled or
merged into the turn before it, and empty turns are inserted, at the least total cost.
The cheapest way through a stretch of turns is known for every pair of states before and
after it, and such tables combine, so a long conversation is split into stretches of
rows, however its turns are numbered: rows are dealt to ranges in their order, and each
range's share of a conversation is cut by row count. Stretches are summed up apart, a short pass over the tables fixes the states between
them, and each stretch is then repaired and rendered by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
#: The states that a turn of each role may follow.
AFTER = {SYSTEM: (START,), USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
KEEP, MERGE, RELABEL, MERGE_RELABEL, INSERT = "keep", "merge", "relabel", "merge+relabel", "insert"
COST = {KEEP: 0, MERGE: 1, RELABEL: 2, MERGE_RELABEL: 3, INSERT: 3}
#: Rows in a stretch.
STRETCH = 2_000
#: Characters of a text that rows are dealt to ranges by.
PREFIX = 200
OPEN, CLOSE = "<|{role}|>\n", "<|end|>\n"
#: What begins a mark; in texts it gets one bar more, so that no text makes a turn.
MARK = re.compile(r"<(?=\|)")
FAR = 1 << 60


def _inserts() -> dict[tuple[int, int], tuple[int, ...]]:
    """The shortest legal run of empty user and assistant turns from one state to another."""
    found = {(s, s): () for s in range(4)}
    for _ in range(3):
        for (a, b), roles in list(found.items()):
            for role in (USER, ASSISTANT):
                if b in AFTER[role] and len(roles) + 1 < len(found.get((a, role), (0,) * 9)):
                    found[a, role] = (*roles, role)
    return found


INSERTS = _inserts()


def _steps(role: int) -> list[tuple[int, int, int, tuple[int, ...], str]]:
    """Ways of taking a turn of the role (0: unknown): state before, after, cost, roles inserted first, action."""
    out = []
    for before in range(4):
        for new in (SYSTEM, USER, ASSISTANT):
            for middle in range(4):
                if (before, middle) in INSERTS and middle in AFTER[new]:
                    action = KEEP if new == role else RELABEL
                    out.append((before, new, COST[action] + COST[INSERT] * len(INSERTS[before, middle]), INSERTS[before, middle], action))
        if before:
            action = MERGE if before == role else MERGE_RELABEL
            out.append((before, before, COST[action], (), action))
    best: dict = {}
    for step in out:  # the first of the cheapest
        if step[2] < best.get(step[:2], (0, 0, FAR))[2]:
            best[step[:2]] = step
    return sorted(best.values())


STEPS = [_steps(role) for role in range(4)]


def role_of(name: str | None) -> int:
    name = (name or "").strip().lower()
    return ROLES.index(name) if name in ROLES else 0


def shown_text(text: str | None) -> str:
    """A text in a rendered turn: "<" before bars gets one bar more, which taking one away undoes."""
    return MARK.sub("<|", text or "")


def table_of(roles: Iterable[int]) -> list[list[tuple[int, int]]]:
    """For each state before and after the turns: the least cost, and how many turns that way makes."""
    table = [[(0, 0) if a == b else (FAR, 0) for b in range(4)] for a in range(4)]
    for role in roles:
        new = [[(FAR, 0)] * 4 for _ in range(4)]
        for a in range(4):
            for before, after, cost, inserted, action in STEPS[role]:
                old, made = table[a][before]
                if old + cost < new[a][after][0]:
                    new[a][after] = old + cost, made + len(inserted) + (action in (KEEP, RELABEL))
        table = new
    return table


def path_of(roles: list[int], begin: int, end: int) -> list[tuple[tuple[int, ...], str, int]]:
    """Roles inserted before, action and new role of each turn, on the way that table_of counts."""
    costs, back = [FAR] * 4, []
    costs[begin] = 0
    for role in roles:
        new, came = [FAR] * 4, [None] * 4
        for step in STEPS[role]:
            if costs[step[0]] + step[2] < new[step[1]]:
                new[step[1]], came[step[1]] = costs[step[0]] + step[2], step
        costs = new
        back.append(came)
    out = []
    for came in reversed(back):
        before, after, _, inserted, action = came[end]
        out.append((inserted, action, after))
        end = before
    return out[::-1]


def _groups(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows in a row that share their first columns."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
    return groupby(rows, key=lambda r: r[:width])


def _emit(rows: Iterable[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) >= 20_000:
            yield pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*part), fields)], names=[n for n, _ in fields])
            part = []
    columns = zip(*part) if part else [[]] * len(fields)
    yield pa.record_batch([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


_CELLS = ", ".join(f"c{a}{b} long, m{a}{b} long" for a in range(4) for b in range(4))
_TABLES = f"conv_id long, stretch long, {_CELLS}"
_STATES = "conv_id long, stretch long, begin int, stop int, made long, cost long, last boolean"
_TURNS = "conv_id long, turn long, role string, action string, new_role string, new_turn long, rendered string, cost long"


def _sum_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for key, turns in _groups(batches, 2):
            table = table_of(role_of(t[2]) for t in turns)
            yield (*key, *(x for line in table for cell in line for x in cell))

    return _emit(rows(), _TABLES)


def _fix_states(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for (conv_id,), parts in _groups(batches, 1):
            costs, back, keys = [0, FAR, FAR, FAR], [], []
            for part in parts:  # a row for each stretch
                cell = part[2:]
                new, came = [FAR] * 4, [0] * 4
                for a in range(4):
                    for b in range(4):
                        if costs[a] + cell[8 * a + 2 * b] < new[b]:
                            new[b], came[b] = costs[a] + cell[8 * a + 2 * b], a
                costs = new
                back.append(came)
                keys.append((part[1], cell))
            total, state = min((costs[s] + COST[INSERT] * len(INSERTS[s, ASSISTANT]), s) for s in range(4) if (s, ASSISTANT) in INSERTS)
            ends = [state]
            for came in reversed(back):
                ends.append(came[ends[-1]])
            ends, made = ends[::-1], 0
            for i, (stretch, cell) in enumerate(keys):
                yield conv_id, stretch, ends[i], ends[i + 1], made, total, i == len(keys) - 1
                made += cell[8 * ends[i] + 2 * ends[i + 1] + 1]

    return _emit(rows(), _STATES)


def _render(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for (conv_id, _, begin, stop, made, cost, last), group in _groups(batches, 7):
            turns = [t[7:] for t in group]
            number = made - 1
            pending = None

            def head(role: int) -> str:
                return (CLOSE if number > 0 else "") + OPEN.format(role=ROLES[role])

            for (turn, role, text), (inserted, action, new) in zip(turns, path_of([role_of(t[1]) for t in turns], begin, stop)):
                for extra in inserted:
                    number += 1
                    if pending:
                        yield pending
                    pending = (conv_id, None, None, INSERT, ROLES[extra], number, head(extra), cost)
                if action in (KEEP, RELABEL):
                    number += 1
                    shown = head(new) + shown_text(text) + "\n"
                else:
                    shown = shown_text(text) + "\n"
                if pending:
                    yield pending
                pending = (conv_id, turn, role, action, ROLES[new], number, shown, cost)
            if last:
                for extra in INSERTS[stop, ASSISTANT]:
                    number += 1
                    if pending:
                        yield pending
                    pending = (conv_id, None, None, INSERT, ROLES[extra], number, head(extra), cost)
                pending = (*pending[:6], pending[6] + CLOSE, cost)
            yield pending

    return _emit(rows(), _TURNS)


def _cut(stretch: int):
    """Rows in their order, each with its stretch and its number in the task: conversations are cut anew in each task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, done, now, count = TaskContext.get().partitionId() << 32, 0, None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            column = batch.column(0)
            ids, none = column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)
            new = np.append((none[0], ids[0]) != now, (ids[1:] != ids[:-1]) | (none[1:] != none[:-1]))
            head = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            nth = np.where(head < 0, count + np.arange(n), np.arange(n) - head)
            now, count = (none[-1], ids[-1]), int(nth[-1]) + 1
            yield pa.record_batch([column, pa.array(base + nth // stretch), pa.array(base + done + np.arange(n)), *batch.columns[1:]], names=["conv_id", "stretch", "nth", "turn", "role", "text"])
            done += n

    return run


def repaired(turns: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """conv_id, turn, role, action, new_role, new_turn, rendered, cost: a row for each source or inserted turn.

    rendered is the turn's part of the formatted conversation, whose parts follow each
    other by new_turn and then in the order of turn, role, text; marks of turns inside
    texts get one bar more ("<|end|>" is shown as "<||end|>"); cost is the whole
    conversation's. Rows without conv_id are one conversation; turns without a number
    come last, equal numbers in the order of role and text; unknown and null roles are
    relabelled, null texts empty, and repeated rows are turns of their own. Other columns
    are ignored; texts of any length are rendered whole; an empty table gives an empty result.

    Rows alike in all but a text of more than PREFIX characters, and in so many of its
    first ones, are ordered in one task; they are still cut into stretches.
    """
    read = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")
    )
    begin = [F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last()]
    short = F.coalesce(F.char_length("text"), F.lit(0)) <= PREFIX
    # rows alike in whole short texts are interchangeable: they may go to several ranges
    keyed = read.withColumns({"first": F.left("text", F.lit(PREFIX)), "long": ~short, "any": F.when(short, F.xxhash64(F.monotonically_increasing_id()))})
    ordered = keyed.repartitionByRange(*begin, "first", "long", "any").sortWithinPartitions(*begin, "text")
    numbered = settle(
        ordered.select("conv_id", "turn", "role", "text").mapInArrow(_cut(stretch), "conv_id long, stretch long, nth long, turn long, role string, text string")
    )
    # a stretch lies in one partition of numbered, in order, and so in one task after the join too, however that is dealt
    states = (
        numbered.select("conv_id", "stretch", "role")
        .mapInArrow(_sum_up, _TABLES)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "stretch")
        .mapInArrow(_fix_states, _STATES)
        .select(F.col("conv_id").alias("id"), F.col("stretch").alias("part"), "begin", "stop", "made", "cost", "last")
    )
    joined = numbered.join(states, F.col("conv_id").eqNullSafe(F.col("id")) & (F.col("stretch") == F.col("part")))
    return (
        joined.select("conv_id", "stretch", "begin", "stop", "made", "cost", "last", "turn", "role", "text", "nth")
        .sortWithinPartitions("conv_id", "stretch", "nth")
        .drop("nth")
        .mapInArrow(_render, _TURNS)
    )
