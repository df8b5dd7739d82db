"""Prediction and submission files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpairs.operators.rows import attach_by_index


def write_predictions(df: DataFrame, path: str, fmt: str = "csv", mode: str = "error") -> None:
    """``pred_label, probs`` plus the key columns; CSV holds the array as JSON text."""
    if fmt == "csv":
        df = df.withColumn("probs", F.to_json("probs"))
        df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    else:
        df.write.mode(mode).format(fmt).save(path)


def fill_template(template: DataFrame, preds: DataFrame, index: str = "index", pred: str = "pred_label") -> DataFrame:
    """The template with its ``label`` replaced by the prediction of the same index, null where there is none."""
    labels = preds.select(index, F.col(pred).alias("label"))
    return attach_by_index(template, labels, ["label"], index).select(*template.columns)


def write_submission(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
