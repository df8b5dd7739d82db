"""Span tables. Spans are made by generators inside each row's own task; only the columns named in
``keep`` travel with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpairs.functions.sequences import first_separator, span_mask

BLOCK, STARTS = "_block", "_starts"
BLOCK_SPANS = 32_768
TASK_SPANS = 2_000_000


def _range(first: Column, last: Column) -> Column:
    """first..last as an array, empty when last < first (``sequence`` would count down)."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _with_ends(df: DataFrame, keep: Sequence[str], last: Column, max_width: int | None) -> DataFrame:
    """Explode each start's ends start..last; ``max_width`` bounds end - start."""
    if max_width is not None:
        last = F.least(last, F.col("span_start") + max_width)
    return df.select(*keep, "span_start", F.explode(_range(F.col("span_start"), last)).alias("span_end"))


def enumerate_spans(
    df: DataFrame,
    keep: Sequence[str],
    ids: str = "input_ids",
    length: str = "length",
    max_width: int | None = None,
) -> DataFrame:
    """Every ``1 <= start <= end <= L - 2`` of the (padded) array with its mask, L being the array size."""
    last = F.size(ids) - 2
    starts = df.select(
        *keep,
        F.col(length).cast("int").alias("_length"),
        first_separator(ids).alias("_middle"),
        last.alias("_last"),
        F.explode(_range(F.lit(1), last)).alias("span_start"),
    )
    spans = _with_ends(starts, [*keep, "_length", "_middle"], F.col("_last"), max_width)
    mask = span_mask("span_start", "span_end", "_length", "_middle")
    return spans.select(*keep, "span_start", "span_end", mask.alias("span_mask"))


def span_intervals(
    df: DataFrame, keep: Sequence[str], ids: str = "input_ids", length: str = "length"
) -> DataFrame:
    """The spans of ``enumerate_spans`` as ``span_start, first_end, last_end, span_mask``: the ends of a start that follow each
    other and have the same mask are one row, so there are two rows per start at most. ``expand_intervals`` makes the spans."""
    last = F.size(ids) - 2
    starts = df.select(
        *keep,
        F.col(length).cast("int").alias("_length"),
        first_separator(ids).alias("_middle"),
        last.alias("_last"),
        F.explode(_range(F.lit(1), last)).alias("_start"),
    )
    # Valid ends follow the start, up to the end of its text; a start that is no token of a text has none.
    inside = F.least(F.col("_length") - 2, F.col("_last"))
    stop = F.when(F.col("_start") > F.col("_middle"), inside).otherwise(F.least(F.col("_middle") - 1, inside))
    stop = F.when(F.col("_start") <= inside, stop).otherwise(0)
    end = F.greatest(F.least(stop, F.col("_last")), F.col("_start") - 1)

    def piece(first: Column, last: Column, valid: bool) -> Column:
        mask = F.lit(0 if valid else 1_000_000)
        return F.struct(first.alias("first_end"), last.alias("last_end"), mask.alias("span_mask"))

    pieces = F.array(piece(F.col("_start"), F.col("_stop"), True), piece(F.col("_stop") + 1, F.col("_last"), False))
    rows = starts.withColumn("_stop", end)
    rows = rows.select(*keep, F.col("_start").alias("span_start"), F.explode(pieces).alias("_piece"))
    rows = rows.select(*keep, "span_start", "_piece.first_end", "_piece.last_end", "_piece.span_mask")
    return rows.where(F.col("first_end") <= F.col("last_end"))


def expand_intervals(intervals: DataFrame) -> DataFrame:
    """A row per span, where a score is to be attached."""
    others = [c for c in intervals.columns if c not in ("first_end", "last_end", "span_mask")]
    return intervals.select(*others, F.explode(_range(F.col("first_end"), F.col("last_end"))).alias("span_end"), "span_mask")


def valid_spans(
    df: DataFrame,
    keep: Sequence[str],
    ids: str = "input_ids",
    length: str = "length",
    max_width: int | None = None,
) -> DataFrame:
    """Only the spans with mask 0, made directly: ends of a start before the first separator stop
    before it, the others stop before the closing special. One pass, nothing made to be filtered."""
    middle, last = first_separator(ids), F.col(length).cast("int") - 2
    starts = df.select(
        *keep,
        middle.alias("_middle"),
        last.alias("_last"),
        F.explode(
            F.concat(_range(F.lit(1), F.least(middle - 1, last)), _range(middle + 1, last))
        ).alias("span_start"),
    )
    stop = F.when(F.col("span_start") < F.col("_middle"), F.least(F.col("_middle") - 1, F.col("_last"))).otherwise(
        F.col("_last")
    )
    return _with_ends(starts, keep, stop, max_width)


def span_blocks(
    df: DataFrame, keep: Sequence[str], ids: str = "input_ids", length: str = "length", size: int = BLOCK_SPANS
) -> DataFrame:
    """Blocks of neighbouring starts with about ``size`` spans each, the ids left behind; ``spans_of`` makes their spans.

    A row's blocks need not lie in one task, so a long row is no hot spot.
    """
    last = F.size(ids) - 2
    rows = df.select(
        *keep, F.col(length).cast("int").alias("_length"), first_separator(ids).alias("_middle"), last.alias("_last")
    )
    step = F.greatest(F.lit(1), F.floor(F.lit(size) / F.greatest(F.col("_last"), F.lit(1)))).cast("int")
    first = F.when(F.col("_last") >= 1, F.sequence(F.lit(1), F.col("_last"), step)).otherwise(F.array().cast("array<int>"))
    blocks = rows.select("*", step.alias("_step"), F.posexplode(first).alias(BLOCK, "_first"))
    starts = F.sequence(F.col("_first"), F.least(F.col("_first") + F.col("_step") - 1, F.col("_last")))
    return blocks.select(*keep, "_length", "_middle", "_last", BLOCK, starts.alias(STARTS))


def deal_blocks(blocks: DataFrame, row: str, task_spans: int = TASK_SPANS) -> DataFrame:
    """Blocks dealt to as many tasks as their spans need, and to each core one at least.

    The number is given, since the runtime would merge partitions by the bytes of the blocks, which say nothing of the spans.
    """
    spans = F.sum(F.size(STARTS).cast("bigint") * F.col("_last"))
    tasks = -(-(blocks.agg(spans.alias("n")).first()["n"] or 0) // (2 * task_spans))
    return blocks.repartition(max(tasks, blocks.sparkSession.sparkContext.defaultParallelism), row, BLOCK)


def spans_of(blocks: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Every ``start <= end <= L - 2`` of the blocks' starts with its mask, made where the block is."""
    starts = blocks.select(*keep, "_length", "_middle", "_last", F.explode(STARTS).alias("span_start"))
    ends = starts.select("*", F.explode(_range(F.col("span_start"), F.col("_last"))).alias("span_end"))
    mask = span_mask("span_start", "span_end", "_length", "_middle")
    return ends.select(*keep, "span_start", "span_end", mask.alias("span_mask"))
