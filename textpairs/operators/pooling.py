"""Attention-style weights over spans and layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def masked_softmax(
    spans: DataFrame, row: str = "row_id", score: str = "score", mask: str = "span_mask", weight: str = "weight"
) -> DataFrame:
    """Add the softmax of ``score - mask`` within each row; rows without id are one row.

    Maximum and sum are windows over a row's spans, of which there are at most some hundred thousand (a sequence is
    cut at 512 tokens). Repartition the sequences by ``row`` before their spans are made: the spans then stay where
    they are, here and in the aggregates over rows that follow.
    """
    shifted = F.col(score).cast("double") - F.col(mask)
    over = W.partitionBy(row)
    scaled = spans.withColumn("_e", F.exp(shifted - F.max(shifted).over(over)))
    return scaled.select(*spans.columns, (F.col("_e") / F.sum("_e").over(over)).alias(weight))


def weighted_pool(
    spans: DataFrame, row: str = "row_id", vec: str = "vec", weight: str = "weight", pooled: str = "pooled"
) -> DataFrame:
    """Per row the weighted mean of ``vec``; with softmax weights that is the weighted sum."""
    mean = Summarizer.metrics("mean").summary(array_to_vector(F.col(vec).cast("array<double>")), F.col(weight))
    return spans.groupBy(row).agg(mean.alias("_m")).select(row, vector_to_array("_m.mean").alias(pooled))


def top_spans(
    spans: DataFrame,
    n: int,
    row: str = "row_id",
    weight: str = "weight",
    ties: Sequence[str] = ("span_start", "span_end"),
) -> DataFrame:
    """The ``n`` spans of highest weight per row, ranked from 1; each map task sends at most ``n`` per row."""
    order = W.partitionBy(row).orderBy(F.desc(weight), *ties)
    return spans.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def span_regulariser(
    spans: DataFrame, lamb: float = 1.0, row: str = "row_id", weight: str = "weight"
) -> DataFrame:
    """``lamb`` times the mean over rows of the summed squared weights."""
    per_row = spans.groupBy(row).agg(F.sum(F.col(weight) * F.col(weight)).alias("_s"))
    return per_row.agg((F.avg("_s") * lamb).alias("regulariser"))


def concat_last_layers(
    layers: DataFrame, n: int = 4, row: str = "row_id", layer: str = "layer", vec: str = "vec", out: str = "features"
) -> DataFrame:
    """Per row the vectors of the ``n`` highest layers, last layer first, in one array."""
    last = F.row_number().over(W.partitionBy(row).orderBy(F.desc(layer)))
    kept = layers.select(row, layer, vec).withColumn("_rank", last).where(F.col("_rank") <= n)
    parts = F.sort_array(F.collect_list(F.struct("_rank", vec)))
    return kept.groupBy(row).agg(parts.alias("_p")).select(
        row, F.flatten(F.transform("_p", lambda p: p[vec])).alias(out)
    )
