"""Exact positions without a global sort. Keys are unique.

A position is the number of rows in earlier buckets plus the rank inside the own bucket. Buckets
follow the wanted order and are small, so one exchange on the bucket is all the wide rows see; the
running sum over bucket counts handles at most ``2**bits`` rows per group.

When only a few positions matter (fold borders, hold-out and sample sizes) no wide row moves at
all: ``rows_at`` finds the row at each wanted position from a histogram of the hash, and every
other row is compared with it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce
from math import ceil
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textpairs.functions.hashing import DRAW_BITS, draw
from textpairs.storage import materialise

BUCKET_BITS = 16
MAX_BUCKET_BITS = 20
ROWS_PER_PIECE = 200_000
PIECE_BITS = 33
MAX_GROUPS = 10_000


def as_key(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def hash_bucket(h: Column, bits: int = BUCKET_BITS) -> Column:
    """Leading bits of a draw: rises with the draw, and unique keys fill all buckets alike."""
    if not 0 < bits <= MAX_BUCKET_BITS:
        raise ValueError(f"bits must be in 1..{MAX_BUCKET_BITS}")
    return F.shiftright(h, DRAW_BITS - bits).cast("int")


def _positions(df: DataFrame, bucket: Column, order: Sequence[str], position: str) -> DataFrame:
    """Add the dense 0-based position in (bucket, order); there is one offset for each bucket. The planner decides by the
    size found at run time whether the offsets are sent around."""
    df = df.withColumn("_bucket", bucket)
    offsets = (
        df.groupBy("_bucket")
        .count()
        .select(
            "_bucket",
            F.coalesce(F.sum("count").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(
                "_offset"
            ),
        )
    )
    inside = F.row_number().over(W.partitionBy("_bucket").orderBy(*order)) - 1
    return (
        df.withColumn("_inside", inside)
        .join(offsets, "_bucket")
        .withColumn(position, (F.col("_offset") + F.col("_inside")).cast("bigint"))
        .drop("_bucket", "_inside", "_offset")
    )


def with_position(
    df: DataFrame,
    order: str | Column | Sequence[str | Column] = "index",
    position: str = "position",
    rows_per_piece: int = ROWS_PER_PIECE,
) -> DataFrame:
    """Dense 0-based row number in the order of a unique key, of one column or several, of any orderable type.

    Rows are dealt into ordered pieces, sorted there and stored with their place in the piece; the size of the pieces
    before is added. So a row is shuffled once, no task sees more than a piece, and gaps, dense stretches and outliers of
    the key do not matter: borders come from a sample of it, and the result does not depend on where they fall.
    """
    order = [order] if isinstance(order, (str, Column)) else list(order)
    pieces = max(ceil(df.count() / rows_per_piece), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = df.repartitionByRange(pieces, *order).sortWithinPartitions(*order)
    stored = materialise(sorted_.withColumn("_at", F.monotonically_increasing_id()))
    # The number of the partition stands above the number of the row in it.
    piece = F.shiftright("_at", PIECE_BITS).cast("int")
    inside = F.col("_at").bitwiseAND((1 << PIECE_BITS) - 1)
    sizes = stored.groupBy(piece.alias("_piece")).agg((F.max(inside) + 1).alias("_n"))
    before = F.sum("_n").over(W.orderBy("_piece").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("_piece", F.coalesce(before, F.lit(0)).alias("_offset"))
    placed = stored.withColumn("_piece", piece).join(offsets, "_piece")
    return placed.withColumn(position, (F.col("_offset") + inside).cast("bigint")).drop("_piece", "_offset", "_at")


def seeded_shuffle(
    df: DataFrame,
    seed: int = 42,
    key: str | Sequence[str] = "index",
    position: str = "position",
    bits: int = BUCKET_BITS,
) -> DataFrame:
    """A full permutation as a dense 0-based position, the same for a seed under any partitioning."""
    key = as_key(key)
    return _positions(
        df.withColumn("_h", draw(seed, key)), hash_bucket(F.col("_h"), bits), ["_h", *key], position
    ).drop("_h")


class Cuts(NamedTuple):
    """Rows at wanted positions per group: ``table`` has one row per group and is small and checked."""

    table: DataFrame
    width: int


def group_sizes(histogram: DataFrame, group: Sequence[str]) -> dict[tuple, int]:
    """Rows per group, collected; more than ``MAX_GROUPS`` groups is an error."""
    rows = histogram.groupBy(*group).agg(F.sum("count").alias("count")).limit(MAX_GROUPS + 1).collect()
    if len(rows) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} distinct values of {list(group)}")
    return {tuple(r[g] for g in group): r["count"] for r in rows}


@contextmanager
def hash_histogram(
    df: DataFrame, group: Sequence[str], key: Sequence[str], seed: int, bits: int = BUCKET_BITS
) -> Iterator[DataFrame]:
    """Rows per group and hash bucket, held while sizes and cuts are read from it.

    Counted before the shuffle, so the largest group is no hot spot.
    """
    counted = df.select(*group, hash_bucket(draw(seed, key), bits).alias("_bucket")).groupBy(*group, "_bucket").count()
    counted.persist()
    try:
        yield counted
    finally:
        counted.unpersist()


def rows_at(
    df: DataFrame,
    histogram: DataFrame,
    wanted: dict[tuple, list[int]],
    group: Sequence[str],
    key: Sequence[str],
    seed: int,
    bits: int = BUCKET_BITS,
) -> Cuts:
    """``(hash, key)`` of the row at each wanted 1-based position of its group in hash order.

    Position 0 stands before the first row. Only rows of the few buckets that hold a wanted position
    are ranked. The outcome (groups times positions) is collected and sent to every task.
    """
    spark = df.sparkSession
    group, key = list(group), list(key)
    width = max((len(v) for v in wanted.values()), default=0)
    if len(wanted) * max(width, 1) > MAX_GROUPS * 10:
        raise ValueError("too many group positions to hold in one small table")
    if width == 0:
        return Cuts(spark.createDataFrame([], df.select(*group).schema), 0)
    types = {f.name: f.dataType for f in df.select(*group, *key).schema.fields}
    asked = _small_table(
        spark,
        {**{g: [k[i] for k in wanted] for i, g in enumerate(group)}, "_wanted": [list(map(int, v)) for v in wanted.values()]},
        {g: types[g].simpleString() for g in group} | {"_wanted": "array<bigint>"},
    )
    in_group = W.partitionBy(*group).orderBy("_bucket")
    upto = F.sum("count").over(in_group)
    hits = (
        histogram.withColumn("_upto", upto)
        .join(F.broadcast(_renamed(asked, group)), _same(group))
        .withColumn(
            "_pos",
            F.explode(
                F.array_distinct(
                    F.filter("_wanted", lambda p: (p > F.col("_upto") - F.col("count")) & (p <= F.col("_upto")))
                )
            ),
        )
        .select(*group, "_bucket", "_pos", (F.col("_pos") - F.col("_upto") + F.col("count")).alias("_rank"))
    )
    at_bucket = [*group, "_bucket"]
    hit_rows = hits.collect()
    hit_types = {g: types[g].simpleString() for g in group} | {"_bucket": "int", "_pos": "bigint", "_rank": "bigint"}
    hit = _small_table(spark, {c: [r[c] for r in hit_rows] for c in hit_types}, hit_types)
    narrow = df.select(*group, *key, draw(seed, key).alias("_h")).withColumn("_bucket", hash_bucket(F.col("_h"), bits))
    ranked = narrow.join(F.broadcast(_renamed(hit, at_bucket)), _same(at_bucket), "left_semi").withColumn(
        "_rank", F.row_number().over(W.partitionBy(*at_bucket).orderBy("_h", *key)).cast("bigint")
    )
    hit_rank = [*at_bucket, "_rank"]
    found = ranked.join(F.broadcast(_renamed(hit, hit_rank)), _same(hit_rank)).select(*group, "_pos", "_h", *key).collect()
    at = {(tuple(r[g] for g in group), r["_pos"]): r for r in found}

    names = [f"_cut{j}" for j in range(width)]
    columns: dict[str, list] = {g: [k[i] for k in wanted] for i, g in enumerate(group)}
    dtypes = {g: types[g].simpleString() for g in group}
    for j, name in enumerate(names):
        rows = [at.get((k, v[j])) if j < len(v) else None for k, v in wanted.items()]
        columns[name] = [None if r is None else r["_h"] for r in rows]
        dtypes[name] = "bigint"
        for c in key:
            columns[f"{name}_{c}"] = [None if r is None else r[c] for r in rows]
            dtypes[f"{name}_{c}"] = types[c].simpleString()
    return Cuts(_small_table(spark, columns, dtypes), width)


def _renamed(table: DataFrame, cols: Sequence[str]) -> DataFrame:
    return table.withColumnsRenamed({c: f"_of_{c}" for c in cols})


def _same(cols: Sequence[str]) -> Column:
    """Equal in all columns; null equals null, so rows without a label are a class of their own."""
    return reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in cols])


def _small_table(spark, columns: dict[str, list], dtypes: dict[str, str]) -> DataFrame:
    """A driver-side table as a local relation, so that its size is known to the planner."""
    schema = to_arrow_schema(T._parse_datatype_string(", ".join(f"`{n}` {dtypes[n]}" for n in columns)))
    return spark.createDataFrame(pa.table([pa.array(v, type=schema.field(n).type) for n, v in columns.items()], names=list(columns)))


def attach_cuts(df: DataFrame, cuts: Cuts, group: Sequence[str], key: Sequence[str], seed: int) -> DataFrame:
    """Add the group's cut columns and ``_h`` to every row; a map-side join with the small table."""
    table = _renamed(cuts.table, group)
    return df.withColumn("_h", draw(seed, key)).join(F.broadcast(table), _same(group), "left").drop(*[f"_of_{g}" for g in group])


def not_after(cut: int, key: Sequence[str]) -> Column:
    """True where the row is at or before cut ``cut`` of its group; false where there is no cut row."""
    here = F.struct("_h", *key)
    there = F.struct(F.col(f"_cut{cut}").alias("_h"), *[F.col(f"_cut{cut}_{k}").alias(k) for k in key])
    return F.col(f"_cut{cut}").isNotNull() & (here <= there)
