"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textpairs.storage import materialise

SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def col(name: str) -> Column:
    """Column by its literal name, dots and clashing case of other columns notwithstanding."""
    return F.col(f"`{name}`")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold_ascii(text: Column) -> Column:
    """A-Z to lower case; every other letter stays."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    r"""Maximal runs of characters other than ``[\x20\x09-\x0D]``; null or blank text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def digest(*cols: Column | str) -> list[Column]:
    """Two independent 64-bit hashes of the same values, 128 bits together."""
    return [F.xxhash64(*cols).alias("h1"), F.xxhash64(F.lit(1), *cols).alias("h2")]


def running_totals(df: DataFrame, order: Sequence[str], weights: dict[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """Exact sums of each weight over all rows before a row in ``order``, and the grand totals.

    Rows are dealt into ordered pieces, each piece is summed on its own and gets the sum of the pieces
    before it. ``order`` should tell rows apart, so that a frequent value is spread over pieces. Only
    one row per piece is sorted in one task or sent to all.
    """
    spark = df.sparkSession
    pieces = 2 * partitions(spark)
    ranged = df.withColumns({f"_w_{k}": w.cast("bigint") for k, w in weights.items()})
    stored = materialise(ranged.repartitionByRange(pieces, *order).withColumn("_piece", F.spark_partition_id()))
    sums = stored.groupBy("_piece").agg(*[F.sum(f"_w_{k}").alias(f"_s_{k}") for k in weights])
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_piece", *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_s_{k}") for k in weights])
    totals = sums.agg(*[F.coalesce(F.sum(f"_s_{k}"), F.lit(0)).alias(k) for k in weights]).first().asDict()
    inside = Window.partitionBy("_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = stored.join(F.broadcast(starts), "_piece")
    for k in weights:
        out = out.withColumn(k, F.col(f"_s_{k}") + F.coalesce(F.sum(f"_w_{k}").over(inside), F.lit(0)))
    return out.drop("_piece", *[f"_w_{k}" for k in weights], *[f"_s_{k}" for k in weights]), totals
