"""Counts and length profiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def _lengths(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per text with its length in code points; all columns in one pass over the data."""
    pairs = [F.struct(F.lit(c).alias("column"), F.char_length(c).alias("length")) for c in cols]
    return df.select(F.explode(F.array(*pairs)).alias("_x")).select("_x.column", "_x.length").where("length is not null")


def length_histogram(df: DataFrame, cols: Sequence[str] = ("premise", "hypothesis"), width: int = 10) -> DataFrame:
    start = (F.floor(F.col("length") / width) * width).cast("bigint")
    return _lengths(df, cols).groupBy("column", start.alias("bin_start")).agg(F.count("*").alias("n"))


def length_summary(
    df: DataFrame, cols: Sequence[str] = ("premise", "hypothesis"), shares: Sequence[float] = (0.5, 0.9)
) -> DataFrame:
    """Exact figures: lengths are counted first, so percentiles weigh distinct lengths, not rows."""
    counted = _lengths(df, cols).groupBy("column", "length").agg(F.count("*").alias("_n"))
    total = F.sum(F.col("length").cast("bigint") * F.col("_n")) / F.sum("_n")
    return counted.groupBy("column").agg(
        F.sum("_n").alias("n"),
        F.min("length").cast("bigint").alias("min_length"),
        F.max("length").cast("bigint").alias("max_length"),
        total.alias("avg_length"),
        *[F.percentile("length", p, F.col("_n")).alias(f"p{round(p * 100)}") for p in shares],
    )


def dataset_sizes(**parts: DataFrame) -> DataFrame:
    """Rows per named part; every part is counted in place and one row per part is moved."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n") for name, df in parts.items()]
    return reduce(DataFrame.unionByName, counts)
