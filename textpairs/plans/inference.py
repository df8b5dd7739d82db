"""From unlabelled pairs and fitted models to a filled submission."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.sql import DataFrame

from textpairs.operators.models import predict_ensemble
from textpairs.operators.rows import clean_pairs, with_sentinel_label
from textpairs.sources.predictions import fill_template


def predict(df: DataFrame, models: dict[str, Model], index: str = "index") -> DataFrame:
    """``index, pred_label, probs`` of the model ensemble for unlabelled pairs; a row without a text gets none."""
    ready = with_sentinel_label(clean_pairs(df.dropna(subset=["premise", "hypothesis"])))
    return predict_ensemble(ready, models, index)


def submission(template: DataFrame, df: DataFrame, models: dict[str, Model], index: str = "index") -> DataFrame:
    """The template with the predicted labels of ``df``; null for a row that could not be scored."""
    return fill_template(template, predict(df, models, index), index)
