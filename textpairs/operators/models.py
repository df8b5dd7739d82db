"""Fold training and batch scoring with Spark ML or a user's model."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from math import ceil
from multiprocessing.pool import ThreadPool
from typing import NamedTuple

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import IDF, ElementwiseProduct, HashingTF, RegexTokenizer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textpairs.functions.scores import argmax, softmax
from textpairs.operators.scoring import accuracy, ensemble_rows
from textpairs.operators.softmax_folds import Run, as_model, fit_jointly, fits_jointly, packed_rows
from textpairs.operators.split import fold_pairs
from textpairs.sources.metrics import append_metrics, metric_rows, run_name
from textpairs.storage import materialise

SCORE_BATCH = 16  # fixed value: rows per model call
FIT_ROWS = 32_768


def default_estimator(
    features: int = 1 << 14, max_iter: int = 50, reg: float = 0.01, aggregation_depth: int = 2
) -> Pipeline:
    """Hashed words of premise, hypothesis and their overlap, weighted by IDF, into a softmax regression."""
    sides = ("premise", "hypothesis", "shared")
    split_words = [
        RegexTokenizer(inputCol=s, outputCol=f"{s}_words", pattern=" ", toLowercase=False) for s in sides[:2]
    ]
    shared = SQLTransformer(
        statement="SELECT *, array_intersect(premise_words, hypothesis_words) AS shared_words FROM __THIS__"
    )
    hashed = [HashingTF(inputCol=f"{s}_words", outputCol=f"{s}_tf", numFeatures=features) for s in sides]
    joined = VectorAssembler(inputCols=[f"{s}_tf" for s in sides], outputCol="tf")
    weighted = IDF(inputCol="tf", outputCol="features")
    regression = LogisticRegression(
        family="multinomial", maxIter=max_iter, regParam=reg, aggregationDepth=aggregation_depth, labelCol="label"
    )
    return Pipeline(stages=[*split_words, shared, *hashed, joined, weighted, regression])


def bayes_estimator(smoothing: float = 1.0) -> Pipeline:
    """Naive Bayes on three counts: premise words, hypothesis words, distinct shared words."""
    counts = SQLTransformer(
        statement="SELECT *, CAST(size(split(premise, ' ')) AS DOUBLE) AS n_premise, "
        "CAST(size(split(hypothesis, ' ')) AS DOUBLE) AS n_hypothesis, "
        "CAST(size(array_intersect(split(premise, ' '), split(hypothesis, ' '))) AS DOUBLE) AS n_shared FROM __THIS__"
    )
    features = VectorAssembler(inputCols=["n_premise", "n_hypothesis", "n_shared"], outputCol="features")
    return Pipeline(stages=[counts, features, NaiveBayes(smoothing=smoothing, modelType="multinomial", labelCol="label")])


def load_models(path: str, folds: Sequence[int], tag: str = "run") -> dict[str, Model]:
    """The models that ``fit_folds`` saved under ``path``, by run name."""
    return {run_name(tag, f): PipelineModel.load(f"{path.rstrip('/')}/{run_name(tag, f)}") for f in folds}


class FoldFit(NamedTuple):
    models: dict[int, Model]
    metrics: DataFrame


def _learned_nothing(estimator: Estimator) -> tuple[list[Transformer], list]:
    """Leading stages that learn nothing, the same for every fold, and the rest."""
    stages = list(estimator.getStages()) if isinstance(estimator, Pipeline) else [estimator]
    n = next((i for i, s in enumerate(stages) if not isinstance(s, Transformer)), len(stages))
    return stages[:n], stages[n:]


class Moments(NamedTuple):
    """Rows, rows with a feature, its mean and the sum of squared distances from the mean."""

    n: int
    documents: np.ndarray
    mean: np.ndarray
    squares: np.ndarray

    def with_(self, other: Moments) -> Moments:
        n, apart = self.n + other.n, other.mean - self.mean
        squares = self.squares + other.squares + apart * apart * (self.n * other.n / n)
        return Moments(n, self.documents + other.documents, self.mean + apart * (other.n / n), squares)


def fold_moments(df: DataFrame, column: str) -> dict[int, Moments]:
    """Moments of a vector column per fold, from one pass over ``df``."""
    summary = Summarizer.metrics("numNonZeros", "mean", "variance").summary(F.col(column))
    found = df.where("fold is not null").groupBy("fold").agg(F.count("*").alias("n"), summary.alias("s")).collect()
    arrays = {r["fold"]: (r["n"], *(r["s"][m].toArray() for m in ("numNonZeros", "mean", "variance"))) for r in found}
    return {fold: Moments(n, documents, mean, variance * (n - 1)) for fold, (n, documents, mean, variance) in arrays.items()}


def fold_weights(df: DataFrame, idf: IDF, k: int, moments: dict[int, Moments] | None = None) -> dict[int, ElementwiseProduct]:
    """Inverse document frequencies of each fold's training part from one pass over ``df``, or from its ``moments``.

    Rows and documents with a term are counted per fold; a training part has those of all rows less those of its fold.
    """
    column = idf.getInputCol()
    moments = fold_moments(df, column) if moments is None else moments
    rows = {fold: m.n for fold, m in moments.items()}
    documents = {fold: m.documents for fold, m in moments.items()}
    out = {}
    for fold in range(k):
        n = sum(rows.values()) - rows.get(fold, 0)
        found = sum(documents.values()) - documents.get(fold, 0)
        weights = np.where(found >= idf.getMinDocFreq(), np.log((n + 1) / (found + 1)), 0.0)
        out[fold] = ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol=column, outputCol=idf.getOutputCol())
    return out


def _is_joint(learning: list, label: T.StructField) -> bool:
    """Whether all that is learned is a softmax regression, on its own or after weights by document frequency."""
    *idf, last = learning or [None]
    if not fits_jointly(last) or last.getLabelCol() != label.name or label.metadata:
        return False
    return not idf or (len(idf) == 1 and isinstance(idf[0], IDF) and idf[0].getOutputCol() == last.getFeaturesCol())


def _classes(counts: Sequence[Row], k: int) -> list[np.ndarray] | None:
    """Rows per class of each fold's training part; None unless all end with the same class and have several."""
    held = [r for r in counts if r["fold"] is not None]
    if not held or any(r["label"] is None or r["label"] < 0 or r["label"] != int(r["label"]) for r in held):
        return None
    labels, folds, n = (np.array([r[c] for r in held]).astype(np.int64) for c in ("label", "fold", "count"))
    out = [np.bincount(labels[folds != i], n[folds != i]) for i in range(k)]
    return out if len({len(h) for h in out}) == 1 and all(np.count_nonzero(h) > 1 for h in out) else None


def _regressions(
    stored: DataFrame, column: str, regression: LogisticRegression, counts: Sequence[Row], moments: dict[int, Moments], weights: dict
) -> dict[int, Model]:
    """The regressions of all folds, fitted at the same time; none if that would not be what their estimator does."""
    k = len(weights)
    labels = _classes(counts, k)
    if labels is None or (regression.getFamily() == "auto" and len(labels[0]) < 3):
        return {}
    runs = {}
    for fold, h in enumerate(labels):
        m = reduce(Moments.with_, [m for f, m in moments.items() if f != fold])
        own = np.ones(len(m.mean)) if weights[fold] is None else weights[fold].getScalingVec().toArray()
        runs[fold] = Run(h, m.mean, np.sqrt(m.squares / max(m.n - 1, 1)), own)
    blocks = packed_rows(stored, column, int(sum(m.documents.sum() for m in moments.values())))
    try:
        fitted = fit_jointly(blocks, regression, runs)
    finally:
        blocks.unpersist()
    trains = {fold: train for fold, (train, _) in enumerate(fold_pairs(stored, k))}
    weighted = {fold: train if weights[fold] is None else weights[fold].transform(train) for fold, train in trains.items()}
    return {fold: as_model(regression, fitted[fold], weighted[fold]) for fold in fitted}


def fit_folds(
    df: DataFrame,
    k: int,
    estimator: Estimator | None = None,
    tag: str = "run",
    plm: str = "hashed-words",
    model_path: str | None = None,
    metrics_path: str | None = None,
    parallelism: int = 8,
    evaluate: Callable[[DataFrame], DataFrame] = accuracy,
) -> FoldFit:
    """For each fold of ``df`` (cleaned, encoded, with its ``fold``): fit on the rest, evaluate on the fold.

    What the stages before the first one that learns make of a row is the same in all runs, so it is made once and stored.
    Everything learned comes from the training part alone; document frequencies are those of all rows less those of the
    fold, counted in one pass. Softmax regressions are fitted by passes that all folds share (``fit_jointly``), with the
    models that separate fits give. Of others up to ``parallelism`` are fitted at the same time, each in as many parts as
    hold ``FIT_ROWS`` rows, since every part sends a gradient as long as the model in every step. ``evaluate`` turns
    ``pred, gold`` rows into one row of metrics.
    """
    estimator = default_estimator() if estimator is None else estimator
    spark = df.sparkSession
    shared, learning = _learned_nothing(estimator)
    made = PipelineModel(shared).transform(df) if shared else df
    first = learning[0] if learning else None
    inputs = [first.getInputCol()] if isinstance(first, IDF) else [first.getFeaturesCol()] if hasattr(first, "getFeaturesCol") else []
    wanted = ["label", "fold", *inputs] if inputs else made.columns
    stored = materialise(made.select(*wanted), partition_by=["fold"])
    counts = stored.groupBy("fold", "label").count().collect()
    rows = {f: sum(r["count"] for r in counts if r["fold"] == f) for f in {r["fold"] for r in counts}}
    joint = _is_joint(learning, stored.schema["label"])
    moments = fold_moments(stored, inputs[0]) if joint or isinstance(first, IDF) else {}
    weights = fold_weights(stored, first, k, moments) if isinstance(first, IDF) else {}
    regressions = _regressions(stored, inputs[0], learning[-1], counts, moments, {f: weights.get(f) for f in range(k)}) if joint else {}

    def fit(fold: int, train: DataFrame, validation: DataFrame) -> tuple[Model, dict[str, float]]:
        n = sum(rows.values()) - rows.get(fold, 0)
        own = [weights[fold]] if weights else []
        if fold in regressions:
            fitted = PipelineModel([*own, regressions[fold]])
        else:
            fitted = Pipeline(stages=[*own, *learning[len(own):]]).fit(train.coalesce(max(ceil(n / FIT_ROWS), 1)))
        pred = fitted.transform(validation).select(F.col("prediction").cast("int").alias("pred"), F.col("label").alias("gold"))
        found = evaluate(pred).first().asDict()
        values = {m: v for m, v in found.items() if m != "n" and v is not None}  # an empty fold has no accuracy
        values["train_samples"] = n
        model = PipelineModel([*shared, *fitted.stages])
        if model_path is not None:
            model.write().overwrite().save(f"{model_path.rstrip('/')}/{run_name(tag, fold)}")
        return model, values

    with ThreadPool(min(k, parallelism)) as pool:
        done = pool.starmap(inheritable_thread_target(spark)(fit), [(i, *s) for i, s in enumerate(fold_pairs(stored, k))])
    table = reduce(
        DataFrame.unionByName, [metric_rows(spark, v, tag, fold, plm, k, 0) for fold, (_, v) in enumerate(done)]
    )
    if metrics_path is not None:
        append_metrics(table, metrics_path)
    return FoldFit({fold: model for fold, (model, _) in enumerate(done)}, table)


def _scored(df: DataFrame, model: Model, keep: Sequence[str]) -> DataFrame:
    return model.transform(df).select(
        *keep,
        vector_to_array("rawPrediction").alias("logits"),
        vector_to_array("probability").alias("probs"),
        F.col("prediction").cast("int").alias("pred"),
    )


def score(df: DataFrame, model: Model, keep: Sequence[str] = ("index",)) -> DataFrame:
    """``keep`` columns plus ``logits, probs, pred`` of a fitted Spark ML classifier."""
    return _scored(df, model, keep)


def score_batches(
    df: DataFrame,
    make_fn: Callable,
    inputs: Sequence[str],
    keep: Sequence[str] = ("index",),
    batch_size: int = SCORE_BATCH,
    shapes: Sequence[Sequence[int] | None] | None = None,
) -> DataFrame:
    """The same table from a user's model: ``make_fn`` loads it once per worker and returns a function
    from NumPy batches of ``inputs`` to an array of logits. ``shapes`` gives the size of each array
    input (padded ids, say) and None for a scalar one."""
    predict = predict_batch_udf(
        make_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size, input_tensor_shapes=shapes
    )
    logits = df.select(*keep, predict(*inputs).cast("array<double>").alias("logits"))
    return logits.withColumn("probs", softmax("logits")).withColumn("pred", argmax("logits"))


def _with_logits(df: DataFrame, models: dict[str, Model]) -> tuple[DataFrame, list[str]]:
    """The rows with a column of logits per model; the leading stages that all models share run once."""
    stages = [list(m.stages) if isinstance(m, PipelineModel) else [m] for m in models.values()]
    common = 0
    while all(len(s) > common + 1 and s[common].uid == stages[0][common].uid for s in stages):
        common += 1
    out = PipelineModel(stages[0][:common]).transform(df) if common else df
    columns, held = out.columns, []
    for i, own in enumerate(stages):
        name = f"_logits{i}"
        out = PipelineModel(own[common:]).transform(out).select(*columns, *held, vector_to_array("rawPrediction").alias(name))
        held.append(name)
    return out, held


def score_ensemble(df: DataFrame, models: dict[str, Model], keep: Sequence[str] = ("index",)) -> DataFrame:
    """Long score table ``model_id, keep.., logits`` of every model in one pass over the rows."""
    out, held = _with_logits(df, models)
    each = [F.struct(F.lit(str(m)).alias("model_id"), F.col(c).alias("logits")) for m, c in zip(models, held)]
    return out.select(*keep, F.explode(F.array(*each)).alias("_s")).select("_s.model_id", *keep, "_s.logits")


def predict_ensemble(df: DataFrame, models: dict[str, Model], index: str = "index") -> DataFrame:
    """``index, pred_label, probs`` of each row from the means over the models, taken inside the row: no shuffle."""
    out, held = _with_logits(df, models)
    return ensemble_rows(out, held, index)


def out_of_fold(df: DataFrame, models: dict[int, Model], keep: Sequence[str] = ("index", "label", "fold")) -> DataFrame:
    """Each row scored by the model that was fitted without its fold.

    A frame stored with ``partition_by=["fold"]`` is read once in all, one folder per model.
    """
    parts = [_scored(df.where(F.col("fold") == fold), model, keep) for fold, model in models.items()]
    return reduce(DataFrame.unionByName, parts)
