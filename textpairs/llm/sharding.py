"""Hilbert-curve shards: rows sorted along a space-filling curve over several metadata columns and cut into runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpairs.llm.common import col, running_totals
from textpairs.storage import materialise

BITS = 6


def curve_automaton(n: int) -> tuple[list[int], list[int]]:
    """Next state and curve digit for each (state, cell of a 2^n cube), flattened; state 0 starts.

    A state is the corner at which the curve enters a cube and the axis along which it leaves it.
    """
    full = (1 << n) - 1

    def rotate_right(x: int, by: int) -> int:
        by %= n
        return ((x >> by) | (x << (n - by))) & full

    def trailing_ones(x: int) -> int:
        return (~x & (x + 1)).bit_length() - 1

    states, following, digits = {(0, 0): 0}, [], []
    queue = [(0, 0)]
    for entry, axis in queue:
        for cell in range(1 << n):
            gray = rotate_right(cell ^ entry, axis + 1)
            digit = gray
            for shift in range(1, n):
                digit ^= gray >> shift
            corner = 0 if digit == 0 else (lambda i: i ^ (i >> 1))(2 * ((digit - 1) // 2))
            turn = 0 if digit == 0 else trailing_ones(digit - 1 if digit % 2 == 0 else digit) % n
            state = (entry ^ rotate_right(corner, n - (axis + 1) % n), (axis + turn + 1) % n)
            if state not in states:
                states[state] = len(states)
                queue.append(state)
            following.append(states[state])
            digits.append(digit)
    return following, digits


def hilbert_index(levels: Sequence[Column], bits: int = BITS) -> Column:
    """Place on the Hilbert curve through a cube of ``2^bits`` levels per dimension."""
    n = len(levels)
    following, digits = curve_automaton(n)
    levels = [level.cast("int") for level in levels]

    def step(acc: Column, b: Column) -> Column:
        at = acc["state"] * (1 << n)
        for j, level in enumerate(levels):
            at = at + (F.call_function("shiftright", level, b) % 2) * (1 << j)
        return F.struct(
            F.get(F.lit(following), at).alias("state"),
            (acc["place"] * (1 << n) + F.get(F.lit(digits), at)).alias("place"),
        )

    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("bigint").alias("place"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda acc: acc["place"])


def size_level(size: Column, bits: int = BITS) -> Column:
    """Half-octave level of a positive whole number: its bit length and the bit after the first."""
    binary = F.bin(size)
    level = 2 * (F.length(binary) - 1) + (F.substring(binary, 2, 1) == "1").cast("int")
    return F.least(level, F.lit((1 << bits) - 1))


def value_levels(df: DataFrame, name: str, bits: int = BITS) -> DataFrame:
    """Each distinct value of ``name`` with its level: the share of rows whose value sorts before it."""
    counts = df.groupBy(col(name).alias("value")).agg(F.count("*").alias("n"))
    placed, totals = running_totals(counts, ["value"], {"before": F.col("n")})
    level = F.floor(F.col("before") * (1 << bits) / F.lit(max(totals["before"], 1))).cast("int")
    return placed.select("value", level.alias("level"))


def hilbert_shards(
    docs: DataFrame,
    shards: int,
    key: str = "doc_id",
    text: str = "text",
    dimensions: Sequence[str] = ("lang", "source"),
    law: str = "rows",
    bits: int = BITS,
) -> DataFrame:
    """Shards that are runs of a Hilbert curve over ``dimensions`` and the text size.

    Returns ``doc_id, <dimensions>, size, text_crc32, curve, shard, slot``. Law ``rows`` makes the counts of
    shards at most one apart, ``bytes`` cuts where the bytes before a row pass an equal share. Rows in one cell of
    the curve follow by key, checksum and size, so a cell that holds most rows is cut like any other.

    A null text has no bytes and checksum 0; a null dimension is a value before all others; null keys sort first;
    repeated rows take slots of their own; an empty table gives no rows; other columns are left out, whatever
    their names. Only sizes, checksums and dimensions are moved, never texts.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"unknown law {law!r}")
    body = F.coalesce(col(text), F.lit(""))
    rows = docs.select(
        col(key).alias("doc_id"),
        *[col(d).alias(f"d{j}") for j, d in enumerate(dimensions)],
        (F.octet_length(body) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(body, "utf-8")).alias("text_crc32"),
    )
    rows = materialise(rows)
    levels = []
    for j in range(len(dimensions)):
        found = value_levels(rows, f"d{j}", bits).select(F.col("value").alias(f"v{j}"), F.col("level").alias(f"l{j}"))
        rows = rows.join(materialise(found), F.col(f"d{j}").eqNullSafe(F.col(f"v{j}")), "left").drop(f"v{j}")
        levels.append(F.coalesce(F.col(f"l{j}"), F.lit(0)))
    curve = hilbert_index([*levels, size_level(F.col("size"), bits)], bits)
    rows = rows.withColumn("curve", curve).drop(*[f"l{j}" for j in range(len(dimensions))])
    placed, totals = running_totals(
        rows, ["curve", "doc_id", "text_crc32", "size"], {"rank": F.lit(1), "bytes_before": F.col("size")}
    )
    before, total = ("rank", totals["rank"]) if law == "rows" else ("bytes_before", totals["bytes_before"])
    shard = F.call_function("div", F.col(before) * shards, F.lit(max(total, 1)).cast("bigint")).cast("int")
    placed = placed.withColumn("shard", shard)
    if law == "rows":
        first = F.call_function("div", F.col("shard") * total + shards - 1, F.lit(shards).cast("bigint"))
        placed = placed.withColumn("slot", F.col("rank") - first)
    else:
        starts = placed.groupBy("shard").agg(F.min("rank").alias("first"))
        placed = placed.join(F.broadcast(starts), "shard").withColumn("slot", F.col("rank") - F.col("first"))
    return placed.select(
        "doc_id",
        *[F.col(f"d{j}").alias(d) for j, d in enumerate(dimensions)],
        "size",
        "text_crc32",
        "curve",
        "shard",
        "slot",
    )
