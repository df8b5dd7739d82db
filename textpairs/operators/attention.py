"""Softmax over all spans of a sequence, from sums that need neither a sorted nor a whole row.

The score of a span lies in a piece of the line that is ``PIECE`` long, and its exponential is taken from the piece's lower
end, where it is between 1 and about 1e111. Sums of these, per row and piece, add up over tasks in any order; the pieces of a row are put
together in the end, where all but the two highest vanish. So a row's spans may be spread over many tasks, each task
sends one line per row and piece, and the greatest score need not be known before.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpairs.operators.spans import BLOCK, STARTS, deal_blocks

PIECE = 256.0


class SpanAttention:
    """Weights of the spans that ``scored`` makes of blocks of starts (see ``spans.span_blocks``).

    ``scored(blocks, keep)`` returns the spans of some blocks with their ``score`` and ``mask`` and the block columns
    ``keep``; it is run anew for each pass, so it must be a plan without an exchange and give the same scores each time.
    Rows without id are one row. Spans with a null or NaN score have no weight and take part in nothing; a score of minus
    infinity has weight 0.
    """

    def __init__(
        self,
        blocks: DataFrame,
        scored: Callable[[DataFrame, Sequence[str]], DataFrame],
        row: str = "row_id",
        score: str = "score",
        mask: str = "span_mask",
    ):
        self.blocks, self.scored, self.row = blocks, scored, row
        self.shifted = F.col(score).cast("double") - F.col(mask)

    def _spans(self, blocks: DataFrame, *keep: str) -> DataFrame:
        return self.scored(deal_blocks(blocks, self.row), [self.row, BLOCK, *keep]).withColumn("_x", self.shifted)

    def _pieces(self, by: Sequence[str], sums: dict[str, Column] | None = None) -> DataFrame:
        """Sums per row and piece: of exponentials, of their squares, and of them times the values of ``sums``."""
        finite = self._spans(self.blocks).where((F.col("_x") > float("-inf")) & ~F.isnan("_x"))
        placed = finite.withColumn("_k", F.floor(F.col("_x") / PIECE))
        placed = placed.withColumn("_e", F.exp(F.col("_x") - F.col("_k") * PIECE))
        e = F.col("_e")
        more = [F.sum(e * value).alias(name) for name, value in (sums or {}).items()]
        return placed.groupBy(self.row, *by, "_k").agg(
            F.max("_x").alias("_most"), F.sum(e).alias("_s"), F.sum(e * e).alias("_q"), *more
        )

    @staticmethod
    def _total(pieces: Column, name: str, times: int = 1) -> Column:
        """The pieces' sums of one name, relative to the highest piece."""
        top = F.array_max(F.transform(pieces, lambda p: p["_k"]))
        scale = lambda p: F.exp((p["_k"] - top) * (PIECE * times))
        return F.aggregate(pieces, F.lit(0.0), lambda total, p: total + p[name] * scale(p))

    def _rows(self, pieces: DataFrame, names: Sequence[str] = (), *more: Column) -> DataFrame:
        """Per row the list of its pieces and ``_log``, the logarithm of the sum of all exponentials."""
        one = F.struct("_k", "_s", "_q", *names)
        rows = pieces.groupBy(self.row).agg(F.collect_list(one).alias("_p"), *more)
        top = F.array_max(F.transform("_p", lambda p: p["_k"]))
        return rows.withColumn("_log", F.log(self._total(F.col("_p"), "_s")) + top * PIECE)

    def _with_rows(self, rows: DataFrame, *columns: str) -> DataFrame:
        """Blocks with values of their row; rows are far fewer than spans and are hashed, not sorted."""
        of = rows.select(F.col(self.row).alias("_of"), *columns).hint("shuffle_hash")
        return self.blocks.join(of, F.col(self.row).eqNullSafe(F.col("_of")), "left").drop("_of")

    def weights(self, weight: str = "weight") -> DataFrame:
        """Every span with its weight: a second pass over the blocks, which bring the sum of their row along."""
        spans = self._spans(self._with_rows(self._rows(self._pieces([])), "_log"), "_log")
        share = F.when(~F.isnan("_x"), F.exp(F.col("_x") - F.col("_log")))
        return spans.withColumn(weight, share).drop("_x", "_log", BLOCK)

    def pool(self, vec: str, size: int, pooled: str = "pooled") -> DataFrame:
        """Per row the sum of the vectors times their weights; ``size`` is the length of the vectors. One pass."""
        sums = {f"_v{i}": F.col(vec)[i].cast("double") for i in range(size)}
        rows = self._rows(self._pieces([], sums), list(sums))
        total = self._total(F.col("_p"), "_s")
        return rows.select(self.row, F.array(*[self._total(F.col("_p"), v) / total for v in sums]).alias(pooled))

    def squares(self) -> DataFrame:
        """Per row the sum of the squared weights, ``squares``. One pass."""
        rows = self._rows(self._pieces([]))
        total = self._total(F.col("_p"), "_s")
        return rows.select(self.row, (self._total(F.col("_p"), "_q", 2) / (total * total)).alias("squares"))

    def regulariser(self, lamb: float = 1.0) -> DataFrame:
        """``lamb`` times the mean over rows of the summed squared weights."""
        return self.squares().agg((F.avg("squares") * lamb).alias("regulariser"))

    def top(self, n: int, weight: str = "weight") -> DataFrame:
        """The ``n`` spans of highest weight per row, ranked from 1; ties by start, then end.

        They start at the ``n`` best starts, by the highest score of a start and then its place. The first pass finds these, the
        second one makes their spans only, ``n`` times the length of the row instead of half its square.
        """
        best = F.sort_array(F.collect_list(F.struct((-F.col("_most")).alias("_worst"), F.col("span_start"))))
        starts = F.slice(F.array_distinct(F.transform(best, lambda b: b["span_start"])), 1, n).alias("_best")
        rows = self._rows(self._pieces([BLOCK, "span_start"]), (), starts)
        blocks = self._with_rows(rows, "_log", "_best")
        blocks = blocks.withColumn(STARTS, F.array_intersect(STARTS, "_best")).where(F.size(STARTS) > 0).drop("_best")
        share = F.exp(F.col("_x") - F.col("_log")).alias(weight)
        spans = self._spans(blocks, "_log").where(~F.isnan("_x"))
        one = F.struct((-F.col("_x")).alias("_worst"), "span_start", "span_end", share)
        rows = spans.groupBy(self.row).agg(F.slice(F.sort_array(F.collect_list(one)), 1, n).alias("_top"))
        ranked = rows.select(self.row, F.posexplode("_top").alias("_at", "_span"))
        return ranked.select(self.row, (F.col("_at") + 1).alias("rank"), "_span.span_start", "_span.span_end", f"_span.{weight}")
