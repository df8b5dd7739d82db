"""Repair of conversations: the auction against dynamic programming, the contract's damage, odd rows."""

import random
import re
import zlib
from collections import defaultdict

import cases
import pytest

from textpairs.llm import catalogue
from textpairs.llm.structure import BLANK, CUT, REPEATED, SOUND, Lattice, damage, faults, repair_conversations

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
FOLLOWING = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """Cost and edits by dynamic programming from the first row on; strings of edits are compared as they grow."""

    def inserted(best):
        for _ in range(2):
            for state, (cost, edits) in list(best.items()):
                put(best, FOLLOWING[state], (cost + 3, edits + "I"))
        return best

    def put(best, state, value):
        best[state] = min(best.get(state, value), value)

    best = inserted({"": (0, "")})
    for initial, fault in rows:
        after = {}
        for state, (cost, edits) in best.items():
            put(after, state, (cost + 4, edits + "D"))
            if fault in (SOUND, CUT):
                extra = 3 * (fault == CUT)
                put(after, FOLLOWING[state], (cost + 3 + extra, edits + "R"))
                if initial == FOLLOWING[state] or initial == "s" and state == "":
                    put(after, initial, (cost + extra, edits + "K"))
        best = inserted(after)
    return min(v for state, v in best.items() if state in ("", "a"))


@pytest.mark.parametrize("strip", [0, 1, 4, 7])
def test_auction_finds_the_cheapest_edits(strip):
    rng = random.Random(strip)
    for _ in range(1500):
        rows = [(rng.choice("sua") if rng.random() < 0.8 else "", rng.choice([SOUND] * 3 + [CUT, BLANK, REPEATED])) for _ in range(rng.randrange(14))]
        assert Lattice(rows, strip).cheapest() == cheapest(rows)


def test_prices_are_lower_bounds_and_tight_on_the_way():
    rng = random.Random(2)
    rows = [(rng.choice("sua"), rng.choice([SOUND, CUT, BLANK])) for _ in range(60)]
    lattice = Lattice(rows)
    for node in range(lattice.end):
        assert all(lattice.prices[node] <= cost + lattice.prices[head] for _, cost, head in lattice.arcs(node))
    assert lattice.prices[0] == cheapest(rows)[0] and lattice.prices[lattice.end] == 0


def test_long_conversation_takes_steps_in_proportion():
    rng = random.Random(3)
    rows = [("ua"[i % 2] if rng.random() < 0.8 else "s", SOUND if rng.random() < 0.9 else CUT) for i in range(20_000)]
    steps = []

    class Counted(Lattice):
        def arcs(self, node):
            steps.append(node)
            return super().arcs(node)

    found = Counted(rows).cheapest()
    assert len(steps) < 60 * len(rows) and found == cheapest(rows)


def test_first_fault_of_each_row():
    roles = ["user", "user", "user", "user", "assistant", "user", "user", "user", "user"]
    texts = [" \t\n\x0b\x0c\r", "", "Hi.", "Hi.", "Hi.", "no end", "end! \n", "\xa0", "Hi.\x1c"]
    assert faults(roles, texts) == [BLANK, BLANK, SOUND, REPEATED, SOUND, CUT, SOUND, CUT, CUT]


def plain(rows):
    """Contract of the query, row by row."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv]
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        harm = zlib.crc32(name.encode()) % 20
        role = "user" if harm == 4 else role
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        groups[conv] += [(turn, role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    out = []
    for conv, found in groups.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        kinds = faults([r[1] for r in found], [r[2] for r in found])
        numbers = {r[0] for r in found if r[0] is not None}
        cost, audit = cheapest([(r[1][:1], k) for r, k in zip(found, kinds)])
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(found, found[1:])]
        lines, at, state = [], 0, ""
        for edit in audit:
            if edit in "KR":
                state = "s" if edit == "K" and found[at][1][:1] == "s" else FOLLOWING[state]
                lines.append((found[at][1] if edit == "K" else {"u": "user", "a": "assistant"}[state]) + ":" + found[at][2])
            elif edit == "I":
                state = FOLLOWING[state]
                lines.append({"u": "user:", "a": "assistant:"}[state])
            at += edit != "I"
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        counts = [kinds.count(k) for k in (BLANK, REPEATED, CUT)]
        out.append((conv, gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, cases.sha("\n".join(lines))))
    return out


def write(spark, rows, folder, schema=SCHEMA):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def test_query_on_odd_rows(spark, tmp_path):
    rng = random.Random(4)
    texts = ["Yes.", "No!", "", " ", None, "cut", "a b. c", "Ünï?", "x" * 50_000 + "."]
    roles = ["user", "assistant", "system", None, "", "User", "tool", "ufo"]
    rows = [
        (rng.choice([None, *range(25)]), rng.choice([None, 0, 1, 2, 3, 5, 9, -4]), rng.choice(roles[:2] * 4 + roles), rng.choice(texts))
        for _ in range(400)
    ]
    # Dropped whole: nothing but its id is left.
    lost = next(i for i in range(100, 999) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows += [(lost, 0, "user", "gone."), *[(40, 1, "user", "same.")] * 5, *[(41, t, "ua"[t % 2] + "x", f"{t}.") for t in range(900)]]
    found = catalogue.QUERIES["op11_auction_repair"](spark, write(spark, rows, tmp_path))
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, plain(rows)))
    assert [tuple(r)[1:] for r in found.where(f"conv_id = {lost}").collect()] == [(0, 0, 0, 0, 0, 0, "", cases.sha(""))]


def test_query_equals_plain_version_on_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = catalogue.QUERIES["op11_auction_repair"](spark, sf_dir).collect()
    assert sorted(map(tuple, found)) == sorted(plain(rows))


def test_turns_come_back_repaired(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "And?"), (1, 3, "user", "And now?"), (2, 0, None, None)]
    odd = [(*r, 1, 2, "x", "y") for r in rows]
    turns = spark.createDataFrame(odd, SCHEMA + ", damaged int, one int, r string, turns string")
    found = {r.conv_id: (r.audit, r.cost, [tuple(t) for t in r.turns]) for r in repair_conversations(turns).collect()}
    # Rerole the first user row instead of inserting; ties go to the ASCII-least edits.
    audit, cost = cheapest([("s", SOUND), ("a", SOUND), ("u", SOUND), ("u", SOUND)])[::-1]
    assert found[1][:2] == (audit, cost) and found[2] == ("D", 4, [])
    initials = "".join(role[:1] for role, _ in found[1][2])
    assert re.fullmatch("(s?(ua)+)?", initials) and {t for _, t in found[1][2]} <= {r[3] for r in rows} | {""}
    assert repair_conversations(turns.where("false")).count() == 0
    assert damage(turns).columns == ["conv_id", "turn", "role", "text", "present"]


def test_result_does_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(5)
    rows = [(i % 3, i % 4, rng.choice(["user", "assistant"]), rng.choice(["a.", "b", ""])) for i in range(60)]
    frames = [spark.createDataFrame(r, SCHEMA).repartition(n) for r, n in ((rows, 1), (rows[::-1], 5))]
    a, b = (sorted(map(repr, repair_conversations(f).collect())) for f in frames)
    assert a == b
