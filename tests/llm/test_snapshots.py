"""Collapse of logged snapshots against a plain version, with repeated turns, ties and rows without id."""

import random

import duckdb
import pytest

from textpairs.llm import catalogue
from textpairs.llm.chat import format_conversations

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain(rows):
    """Maximal conversations by comparing every two; a conversation is a list of (role, text)."""
    named, loose = {}, set()
    for conv, turn, role, text in rows:
        if conv is None:
            loose.add(((role or "", text or ""),))
        else:
            named.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    every = [((0, 0), None, c) for c in loose]
    every += [((1, conv), conv, tuple(r[2:] for r in sorted(found))) for conv, found in named.items()]
    kept = []
    for place, conv, mine in every:
        longer = any(len(o) > len(mine) and o[: len(mine)] == mine for _, _, o in every)
        if not longer and not any(o == mine and p < place for p, _, o in every):
            clean = [(r.replace("<|im_", "<| im_"), t.replace("<|im_", "<| im_")) for r, t in mine]
            kept.append((conv, len(mine), "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in clean)))
    return sorted(map(repr, kept))


def collapsed(spark, rows):
    return sorted(repr(tuple(r)) for r in format_conversations(spark.createDataFrame(rows, SCHEMA)).collect())


def test_a_repeated_turn_is_a_turn(spark):
    said = {1: "h", 2: "hh", 3: "ab", 4: "abbc"}
    same_number = [(conv, 0, "user", t) for conv in (1, 2) for t in said[conv]]
    rows = same_number + [(3, 0, "user", "a"), (3, 1, "user", "b"), (4, 0, "user", "a"), (4, 1, "user", "b"), (4, 1, "user", "b"), (4, 2, "user", "c")]
    found = format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.conv_id for r in found) == [2, 4]


@pytest.mark.parametrize("seed", range(4))
def test_random_snapshots(spark, seed):
    rng = random.Random(seed)
    rows, conv = [], 0
    for _ in range(40):
        turns = [(rng.choice([t, t, max(t - 1, 0)]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "<|im_x", "", None])) for t in range(rng.randrange(1, 7))]
        turns += rng.choices(turns, k=rng.randrange(2))
        turns.sort(key=lambda t: (t[0], t[1] or "", t[2] or ""))
        for _ in range(rng.randrange(1, 4)):
            rows += [(conv, *t) for t in turns[: rng.randrange(1, len(turns) + 1)]]
            conv += 1
    rows += [(None, rng.randrange(3), rng.choice(["user", None]), rng.choice(["a", "b", "c"])) for _ in range(30)]
    rows += [(conv, None, "user", "no number"), (conv, 0, "user", "numbered"), (conv + 1, None, "user", "no number")]
    rng.shuffle(rows)
    assert collapsed(spark, rows) == plain(rows)


def test_table_with_planted_snapshots(spark, sf_dir, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    ids = sorted({r[0] for r in rows})
    for i, conv in enumerate(ids):
        rows += [(10_000 + i, *r[1:]) for r in rows if r[0] == conv and r[1] <= i % 4]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    found = [tuple(r) for r in catalogue.QUERIES["op7_snapshot_collapse"](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, found)) == plain(rows)
    assert sorted(r[0] for r in found) == ids
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(connection.execute(catalogue.ORACLES["op7_snapshot_collapse"]).fetchall()) == sorted(found)
