"""From raw pairs to cleaned, de-duplicated folds and fitted models."""

from __future__ import annotations

from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpairs.functions.labels import encode_label
from textpairs.operators.dedup import dedup_keep_first
from textpairs.operators.models import FoldFit, fit_folds
from textpairs.operators.rows import clean_pairs, drop_incomplete
from textpairs.operators.split import stratified_kfold
from textpairs.storage import materialise


def prepared_pairs(df: DataFrame) -> DataFrame:
    """Complete rows, encoded label, cleaned texts: row-local, so the same on a stream."""
    return clean_pairs(drop_incomplete(df).withColumn("label", encode_label("label")))


def folded_pairs(df: DataFrame, k: int = 5, seed: int = 42, unique: bool = True) -> DataFrame:
    """Prepared pairs with their fold; the prepared table is stored once because the fold borders
    and the final rows are separate passes."""
    ready = prepared_pairs(df)
    if unique:
        ready = dedup_keep_first(ready)
    return stratified_kfold(materialise(ready), k, seed=seed)


def fold_report(df: DataFrame) -> DataFrame:
    return df.groupBy("fold", "label").agg(F.count("*").alias("n"))


def train_folds(
    df: DataFrame, k: int = 5, estimator: Estimator | None = None, seed: int = 42, **options: str
) -> tuple[DataFrame, FoldFit]:
    """The folded table (stored by fold) and one fitted model per fold."""
    stored = materialise(folded_pairs(df, k, seed), partition_by=["fold"])
    return stored, fit_folds(stored, k, estimator, **options)


def mixed_folds(
    folded: DataFrame, external: dict[str, DataFrame] | None = None, derived: dict[str, DataFrame] | None = None
) -> DataFrame:
    """``source, index, premise, hypothesis, label, fold``: the folded pairs (``train``) and rows that only train.

    ``external`` rows have no fold and train in every run. ``derived`` rows (``index`` of the pair they were made from) take
    its fold, so none of them trains a run in which the pair is held out; those of pairs that are not there are left out.
    """
    cols = ("index", "premise", "hypothesis", "label")
    out = folded.select(F.lit("train").alias("source"), *cols, "fold")
    for name, df in (external or {}).items():
        out = out.unionByName(df.select(F.lit(name).alias("source"), *cols, F.lit(None).cast("int").alias("fold")))
    for name, df in (derived or {}).items():
        kept = df.select(*cols).join(folded.select("index", "fold"), "index")
        out = out.unionByName(kept.select(F.lit(name).alias("source"), *cols, "fold"))
    return out


def mixed_runs(mixed: DataFrame, k: int) -> DataFrame:
    """All runs over ``mixed_folds``: each row once per ``run`` it takes part in, marked by ``part``."""
    runs = mixed.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    held = F.coalesce(F.col("run") == F.col("fold"), F.lit(False))
    marked = runs.withColumn("part", F.when(held, "validation").otherwise("train"))
    return marked.where((F.col("source") == "train") | (F.col("part") == "train"))
