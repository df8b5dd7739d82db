"""Damaged conversations back to alternating roles, by the cheapest edits: an auction over the lattice of rows and states."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpairs.llm.common import col

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
STRIP = 4
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWING = (USER, USER, ASSISTANT, USER)
ROLES = (None, "system", "user", "assistant")
ADJACENT = {"su", "ua", "au"}
BLANK, REPEATED, CUT, SOUND = "blank", "duplicate", "truncated", "sound"
LAST = re.compile(r"[^\x20\x09-\x0D][\x20\x09-\x0D]*\Z")
REPAIR = "struct<blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,cost:bigint,audit:string,rows:array<struct<at:int,role:string>>>"


def faults(roles: Sequence[str], texts: Sequence[str]) -> list[str]:
    """The first fault of each row, in the order blank, duplicate, truncated."""
    seen, out = set(), []
    for row in zip(roles, texts):
        last = LAST.search(row[1])
        if last is None:
            out.append(BLANK)
        elif row in seen:
            out.append(REPEATED)
        else:
            out.append(SOUND if last[0][0] in ".!?" else CUT)
        seen.add(row)
    return out


@lru_cache(maxsize=None)
def moves(initial: str, fault: str, state: int) -> tuple[tuple[str, int, int, int], ...]:
    """Edits at a row in a state as (initial, cost, rows passed, state after), in ASCII order; ``fault`` is empty behind the last row."""
    out = [("I", INSERT, 0, FOLLOWING[state])]
    if fault:
        out.insert(0, ("D", DELETE, 1, state))
    if fault in (SOUND, CUT):
        extra = TRUNCATED if fault == CUT else 0
        if initial == "s" and state == EMPTY:
            out.append(("K", KEEP + extra, 1, SYSTEM))
        elif initial == "ua"[FOLLOWING[state] - USER]:
            out.append(("K", KEEP + extra, 1, FOLLOWING[state]))
        out.append(("R", REROLE + extra, 1, FOLLOWING[state]))
    return tuple(out)


class Lattice:
    """Nodes are (rows passed, state), arcs are edits, the end is behind every accepting state of the last row.

    A price per node never exceeds the cost of an arc plus the price of its head. A path grows from its origin: where the price of its
    last node equals the best arc it is extended over that arc, else the price rises to it and the path is contracted by one node.
    When it meets a node whose price is known to be its distance, so are the prices along the path.

    Origins are taken every ``strip`` rows from the end, and the beginning last; prices stay from one to the next, and those ahead of
    a solved row start from its least one, so a path is at most a strip long and the work grows with the rows. ``strip=0`` has the
    beginning as its only origin.
    """

    def __init__(self, rows: Sequence[tuple[str, str]], strip: int = STRIP):
        self.rows = [*rows, ("", "")]
        self.end = 4 * len(self.rows)
        self.prices = [0] * (self.end + 1)
        settled = bytearray(self.end) + b"\1"
        solved = len(rows) + 1
        for at in range(len(rows), 0, -strip) if strip else ():
            self._start(at, solved)
            for state in range(4):
                self._auction(4 * at + state, settled)
            solved = at
        self._start(0, solved)
        self._auction(EMPTY, settled)

    def _start(self, at: int, solved: int) -> None:
        """Raise the prices from a row up to a solved one; none exceeds an arc and the price of its head."""
        if solved < len(self.rows):
            least = min(self.prices[4 * solved : 4 * solved + 4])
            self.prices[4 * at : 4 * solved] = [least] * (4 * (solved - at))

    def arcs(self, node: int) -> list[tuple[str, int, int]]:
        at, state = divmod(node, 4)
        out = [(edit, cost, node + 4 * passed + after - state) for edit, cost, passed, after in moves(*self.rows[at], state)]
        if at == len(self.rows) - 1 and state in (EMPTY, ASSISTANT):
            out.insert(0, ("", 0, self.end))
        return out

    def _auction(self, origin: int, settled: bytearray) -> None:
        prices, path = self.prices, [origin]
        while not settled[path[-1]]:
            node = path[-1]
            best, head = min((cost + prices[head], head) for _, cost, head in self.arcs(node))
            if prices[node] < best:
                prices[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(head)
        for node in path:
            settled[node] = 1

    def cheapest(self) -> tuple[int, str]:
        """Cost and initials of the cheapest edits, of equal ones the ASCII-least.

        Every cheapest path lies on arcs that cost as much as the price falls along them. Of these the ones that lead to the end
        are followed by the least initial; an initial names one arc of a node.
        """
        prices = self.prices
        open_ends = bytearray(self.end) + b"\1"
        for at in range(len(self.rows) - 1, -1, -1):
            # Insertions lead from a state without a role to user and assistant, and between these two.
            for state in (USER, ASSISTANT, USER, SYSTEM, EMPTY):
                node = 4 * at + state
                open_ends[node] = any(open_ends[head] and prices[node] == cost + prices[head] for _, cost, head in self.arcs(node))
        node, audit = EMPTY, []
        while node != self.end:
            tight = ((e, head) for e, cost, head in self.arcs(node) if open_ends[head] and prices[node] == cost + prices[head])
            edit, node = min(tight)
            audit.append(edit)
        return prices[EMPTY], "".join(audit)


@lru_cache(maxsize=100_000)
def _short(rows: tuple[tuple[str, str], ...]) -> tuple[int, str]:
    return Lattice(rows).cheapest()


def cheapest_edits(initials: Sequence[str], found: Sequence[str]) -> tuple[int, str]:
    rows = tuple((i if i in ("s", "u", "a") else "", f) for i, f in zip(initials, found))
    return _short(rows) if len(rows) <= 12 else Lattice(rows).cheapest()


def repair_rows(roles: Sequence[str], texts: Sequence[str]) -> dict:
    """Counts of faults, the cheapest edits, and the rows they leave: place of the text (-1: none) and role."""
    found = faults(roles, texts)
    initials = [r[:1] for r in roles]
    cost, audit = cheapest_edits(initials, found)
    rows, at, state = [], 0, EMPTY
    for edit in audit:
        if edit == "I":
            state = FOLLOWING[state]
            rows.append({"at": -1, "role": ROLES[state]})
            continue
        if edit != "D":
            state = SYSTEM if edit == "K" and initials[at] == "s" else FOLLOWING[state]
            rows.append({"at": at, "role": roles[at] if edit == "K" else ROLES[state]})
        at += 1
    illegal = sum(a + b not in ADJACENT for a, b in zip(initials, initials[1:]))
    counts = {name: found.count(name) for name in (BLANK, REPEATED, CUT)}
    return counts | {"illegal": illegal, "cost": cost, "audit": audit, "rows": rows}


def _repaired(turns: Column) -> Column:
    @F.arrow_udf(REPAIR)
    def repair(turns: pa.Array) -> pa.Array:
        ends, inner = turns.offsets.to_pylist(), turns.values
        roles, texts = (inner.field(name).to_pylist() for name in ("role", "text"))
        out = [repair_rows(roles[a:b], texts[a:b]) for a, b in zip(ends, ends[1:])]
        rows = pa.list_(pa.struct([("at", pa.int32()), ("role", pa.string())]))
        longs = [(name, pa.int64()) for name in (BLANK, REPEATED, CUT, "illegal", "cost")]
        return pa.array(out, pa.struct([*longs, ("audit", pa.string()), ("rows", rows)]))

    return repair(turns)


def repair_conversations(
    turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None
) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, turns``: every conversation, with the cheapest
    edits that make its role initials ``(s?(ua)+)?`` and the turns they leave as an array of ``role, text``.

    A row is blank (nothing but spaces), else a duplicate (role and text seen before), else truncated (its last character is no
    ``.``, ``!`` or ``?``). Edits are written by their initials: keep (0), rerole to user or assistant (3), delete (4, the only one
    for blank rows and duplicates), insert an empty turn (3); a truncated row that stays adds 3. ``illegal`` counts neighbours
    other than su, ua, au; ``gaps`` the numbers missing between the least and the greatest turn, 0 without numbers.

    Rows are taken by turn (nulls first), then role, then text; repeated rows are turns of their own. Null role or text is one
    space. Rows without id are one conversation, whose id is null. ``present`` says which rows are there; the others only name their
    conversation, and one without rows has zeros, an empty audit and no turns. An empty table gives no rows; other columns are left out.
    The rows of one conversation, which become one text, meet in a task.
    """
    there = F.lit(True) if present is None else present
    one = F.struct(
        col(turn).alias("turn"),
        F.coalesce(col(role), F.lit(" ")).alias("role"),
        F.coalesce(col(text), F.lit(" ")).alias("text"),
    )
    rows = turns.select(col(key).alias("conv_id"), F.when(there, one).alias("one"))
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("damaged"))
    found = rows.select("conv_id", "damaged", _repaired(F.col("damaged")).alias("r"))
    numbers = F.array_distinct(F.filter(F.col("damaged.turn"), lambda t: t.isNotNull()))
    gaps = F.coalesce(F.array_max(numbers) - F.array_min(numbers) + 1 - F.size(numbers), F.lit(0)).cast("bigint")
    body = lambda at: F.when(at >= 0, F.col("damaged")[at]["text"]).otherwise("")
    kept = F.transform("r.rows", lambda d: F.struct(d["role"].alias("role"), body(d["at"]).alias("text")))
    counts = [F.col(f"r.{name}") for name in ("blank", "duplicate", "truncated", "illegal", "cost", "audit")]
    return found.select("conv_id", gaps.alias("gaps"), *counts, kept.alias("turns"))


def damage(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, present``: rows dropped (``present`` is false), emptied, cut, repeated or made the user's, one in
    twenty each, by the checksum of ``id:turn``. A null counts as one space; other columns are left out."""
    shown = [F.coalesce(col(c).cast("string"), F.lit(" ")) for c in (key, turn)]
    rows = turns.select(
        col(key).alias("conv_id"),
        col(turn).alias("turn"),
        F.coalesce(col(role), F.lit(" ")).alias("role"),
        F.coalesce(col(text), F.lit(" ")).alias("text"),
        (F.crc32(F.concat_ws(":", *shown).cast("binary")) % 20).alias("harm"),
    )
    harm = F.col("harm")
    changed = F.when(harm.isin(0, 1), "").when(harm == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select(
        "conv_id",
        "turn",
        F.when(harm == 4, "user").otherwise(F.col("role")).alias("role"),
        changed.alias("text"),
        (harm != 0).alias("present"),
        F.explode(F.array_repeat(F.lit(0), F.when(harm == 3, 2).otherwise(1))).alias("copy"),
    )
    return rows.drop("copy")
