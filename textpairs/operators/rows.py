"""Row filters, projections and one-to-one alignment."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpairs.functions.text import clean_text
from textpairs.schema import UNLABELLED


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop a row with a null in any column."""
    return df.na.drop("any")


def project_pairs(df: DataFrame, with_label: bool = True) -> DataFrame:
    return df.select("premise", "hypothesis", "label") if with_label else df.drop("label")


def with_sentinel_label(df: DataFrame) -> DataFrame:
    return df.withColumn("label", F.lit(UNLABELLED))


def clean_pairs(df: DataFrame, fn: Callable[[Column], Column] = clean_text) -> DataFrame:
    """Apply a column-to-column cleaner to both texts; every other column is kept."""
    return df.withColumns({c: fn(F.col(c)) for c in ("premise", "hypothesis")})


def slice_rows(df: DataFrame, start: int, stop: int, index: str = "index") -> DataFrame:
    """Rows with ``start <= index < stop``; the range reaches the Parquet scan."""
    return df.where((F.col(index) >= start) & (F.col(index) < stop))


def attach_by_index(left: DataFrame, right: DataFrame, cols: Sequence[str], index: str = "index") -> DataFrame:
    """Left rows with ``cols`` of the right row of the same index; existing columns are replaced.

    ``index`` is unique on both sides, so no key is hot; which side is sent where is left to the
    runtime sizes.
    """
    kept = [c for c in left.columns if c not in cols]
    return left.select(*kept).join(right.select(index, *cols), index, "left").select(*kept, *cols)


def pending_rows(source: DataFrame, done: DataFrame, index: str = "index") -> DataFrame:
    """Source rows whose index is not in ``done`` yet."""
    return source.join(done.select(index), index, "left_anti")
