"""Fold training with shared features against k separate fits; ensembles inside the row."""

import random

import numpy as np
import pytest
from helpers import plan, rows
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF
from pyspark.sql import functions as F

from textpairs.operators import models, scoring
from textpairs.operators.split import fold_pairs
from textpairs.plans import inference
from textpairs.storage import materialise


@pytest.fixture(scope="module")
def folded(spark):
    rng = random.Random(4)
    data = []
    for i in range(240):
        label = i % 3
        words = [f"w{rng.randrange(12) + 9 * label}" for _ in range(rng.randrange(1, 9))]
        data.append((i, " ".join(words), " ".join(rng.choices(words, k=3)) + f" only{i}", label, i // 3 % 4))
    schema = "index bigint, premise string, hypothesis string, label int, fold int"
    return materialise(spark.createDataFrame(data, schema).repartition(3))


def estimator():
    return models.default_estimator(features=1 << 8, max_iter=15)


@pytest.fixture(scope="module")
def fitted(folded):
    return models.fit_folds(folded, 4, estimator())


def test_same_metrics_as_separate_fits(spark, folded, fitted):
    got = {(r.fold, r.metric): r.value for r in fitted.metrics.collect()}
    for fold, (train, validation) in enumerate(fold_pairs(folded, 4)):
        apart = estimator().fit(train.coalesce(1))
        scored = apart.transform(validation).select(F.col("prediction").cast("int").alias("pred"), F.col("label").alias("gold"))
        assert got[fold, "accuracy"] == pytest.approx(scoring.accuracy(scored).first()["accuracy"])
        assert got[fold, "train_samples"] == train.count()
        want = rows(models.score(validation, apart), "index")
        mine = rows(models.score(validation, fitted.models[fold]), "index")
        assert [r[0] for r in mine] == [r[0] for r in want]
        assert np.allclose([r[1] for r in mine], [r[1] for r in want], atol=1e-6)


@pytest.mark.parametrize("least", [0, 3])
def test_weights_are_all_rows_less_the_fold(folded, least):
    stages = estimator().getStages()
    made = Pipeline(stages=stages[:-2]).fit(folded).transform(folded)
    idf = IDF(inputCol="tf", outputCol="features", minDocFreq=least)
    weights = models.fold_weights(made, idf, 4)
    for fold, (train, _) in enumerate(fold_pairs(made, 4)):
        assert np.allclose(weights[fold].getScalingVec().toArray(), idf.fit(train).idf.toArray())


def test_ensemble_is_taken_inside_the_row(spark, folded, fitted, tmp_path):
    named = {f"run_{i}": m for i, m in fitted.models.items()}
    found = models.predict_ensemble(folded, named)
    long = scoring.ensemble(models.score_ensemble(folded, named), "index")
    got, want = rows(found, "index"), rows(long, "index")
    assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want])
    assert "Exchange" not in plan(found) and "Generate" not in plan(found)
    assert "Exchange" not in plan(inference.predict(folded.drop("label", "fold"), named))
    # Loaded models as well.
    models.fit_folds(folded, 4, models.bayes_estimator(), model_path=str(tmp_path))
    loaded = models.load_models(str(tmp_path), range(4))
    again = rows(models.predict_ensemble(folded, loaded), "index")
    apart = rows(scoring.ensemble(models.score_ensemble(folded, loaded), "index"), "index")
    assert [r[:2] for r in again] == [r[:2] for r in apart]


def test_models_of_different_kinds(folded):
    mixed = {"a": estimator().fit(folded), "b": models.bayes_estimator().fit(folded)}
    found = rows(models.predict_ensemble(folded, mixed), "index")
    want = rows(scoring.ensemble(models.score_ensemble(folded, mixed), "index"), "index")
    assert [r[:2] for r in found] == [r[:2] for r in want]
