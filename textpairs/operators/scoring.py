"""Ensembles, accuracy, losses and run selection over score tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpairs.functions.labels import decode_label
from textpairs.functions.scores import CLASSES, argmax, negative_log_likelihood, smoothed_nll, softmax


def _mean_items(arr: Column, classes: int) -> Column:
    """Element-wise mean as one plain average per class; no list of models is ever collected."""
    return F.array(*[F.avg(arr[i].cast("double")) for i in range(classes)])


def mean_logits(scores: DataFrame, row: str = "row_id", logits: str = "logits", classes: int = CLASSES) -> DataFrame:
    return scores.groupBy(row).agg(_mean_items(F.col(logits), classes).alias("logits"))


def mean_probs(scores: DataFrame, row: str = "row_id", logits: str = "logits", classes: int = CLASSES) -> DataFrame:
    probs = scores.select(row, softmax(logits, classes).alias("_p"))
    return probs.groupBy(row).agg(_mean_items(F.col("_p"), classes).alias("probs"))


def ensemble_labels(scores: DataFrame, row: str = "row_id", logits: str = "logits") -> DataFrame:
    """Label of the mean logits over models."""
    return mean_logits(scores, row, logits).select(row, decode_label(argmax("logits")).alias("pred_label"))


def ensemble_probs(scores: DataFrame, row: str = "row_id", logits: str = "logits") -> DataFrame:
    """Mean over models of each model's own softmax; its maximum need not be the ensemble's label."""
    return mean_probs(scores, row, logits)


def ensemble(scores: DataFrame, row: str = "row_id", logits: str = "logits", classes: int = CLASSES) -> DataFrame:
    """Prediction table ``row, pred_label, probs``: both means in one aggregation."""
    means = (
        scores.select(row, logits, softmax(logits, classes).alias("_p"))
        .groupBy(row)
        .agg(_mean_items(F.col(logits), classes).alias("_l"), _mean_items(F.col("_p"), classes).alias("probs"))
    )
    return means.select(row, decode_label(argmax("_l")).alias("pred_label"), "probs")


def ensemble_rows(df: DataFrame, logits: Sequence[str], row: str = "row_id", classes: int = CLASSES) -> DataFrame:
    """The same table from a column of logits per model: both means are taken inside the row."""
    mean = lambda arrays: F.array(*[reduce(Column.__add__, [a[i] for a in arrays]) / len(arrays) for i in range(classes)])
    probs = df.select(row, *logits, *[softmax(c, classes).alias(f"_p{i}") for i, c in enumerate(logits)])
    label = decode_label(argmax(mean([F.col(c) for c in logits])))
    return probs.select(row, label.alias("pred_label"), mean([F.col(f"_p{i}") for i in range(len(logits))]).alias("probs"))


def accuracy(
    df: DataFrame, by: str | Sequence[str] | None = None, pred: str = "pred", gold: str = "gold"
) -> DataFrame:
    """Share of rows whose prediction equals the gold label, whole or per ``by``; no prediction is wrong."""
    by = [] if by is None else [by] if isinstance(by, str) else list(by)
    hit = F.coalesce(F.col(pred) == F.col(gold), F.lit(False)).cast("double")
    return df.groupBy(*by).agg(F.avg(hit).alias("accuracy"), F.count("*").alias("n"))


def accuracy_by_part(df: DataFrame, part: str = "part", pred: str = "pred", gold: str = "gold") -> DataFrame:
    return accuracy(df, part, pred, gold)


def cross_entropy(df: DataFrame, by: Sequence[str] = (), logits: str = "logits", gold: str = "gold") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(negative_log_likelihood(logits, gold)).alias("loss"))


def smoothed_cross_entropy(
    df: DataFrame, eps: float = 0.2, by: Sequence[str] = (), logits: str = "logits", gold: str = "gold"
) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(smoothed_nll(logits, gold, eps)).alias("loss"))


def best_checkpoint(
    metrics: DataFrame, metric: str | None = "accuracy", by: Sequence[str] = ("run",), step: str = "step"
) -> DataFrame:
    """Per run the step with the highest value of ``metric`` (None: whatever ``by`` tells apart), the
    lowest such step on ties."""
    if metric is not None:
        metrics = metrics.where(F.col("metric") == metric)
    best = F.max(F.struct(F.col("value"), (-F.col(step)).alias("_step"))).alias("_best")
    return (
        metrics.where(F.col("value").isNotNull())
        .groupBy(*by)
        .agg(best)
        .select(*by, (-F.col("_best._step")).alias(step), F.col("_best.value").alias("value"))
    )
