"""Regressions of all folds from shared passes against Spark's own fits."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import types as T

from textpairs.operators import models, softmax_folds
from textpairs.operators.split import fold_pairs

SCHEMA = T.StructType(
    [T.StructField("label", T.IntegerType()), T.StructField("fold", T.IntegerType()), T.StructField("features", VectorUDT())]
)


def vector(rng, label, i):
    """Sparse and dense, counts and fractions, rows without entries, a feature that is always 2."""
    if i % 11 == 0:
        return Vectors.sparse(9, {8: 2.0})
    if i % 3 == 0:
        return Vectors.dense([float(rng.randrange(3)) for _ in range(8)] + [2.0])
    at = sorted(rng.sample(range(8), 3))
    return Vectors.sparse(9, {**{j: 1.0 if rng.random() < 0.7 else rng.random() - 0.3 * label * j for j in at}, 8: 2.0})


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(3)
    folds = [0, 1, 2, 7, None]  # 7 trains in all three runs, no fold in none
    data = [(i % 4, folds[i // 4 % 5], vector(rng, i % 4, i)) for i in range(400)]
    return spark.createDataFrame(data, SCHEMA).repartition(3).localCheckpoint()


def jobs(spark, group, call):
    spark.sparkContext.setJobGroup(group, group)
    out = call()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.mark.parametrize("options", [{"maxIter": 40}, {"maxIter": 7, "family": "multinomial", "regParam": 2.0}, {"maxIter": 60, "tol": 1e-5, "regParam": 1e-3}, {"maxIter": 0}])
def test_steps_are_those_of_separate_fits(vectors, monkeypatch, options):
    estimator = LogisticRegression(**{"regParam": 0.01, **options})
    monkeypatch.setattr(softmax_folds, "PIECE_ENTRIES", 50)
    monkeypatch.setattr(softmax_folds, "BLOCK_ENTRIES", (100, 100))
    fitted = models.fit_folds(vectors, 3, estimator)
    for fold, (train, _) in enumerate(fold_pairs(vectors, 3)):
        want, got = estimator.fit(train), fitted.models[fold].stages[-1]
        assert np.allclose(got.summary.objectiveHistory, want.summary.objectiveHistory, rtol=1e-9)
        assert np.allclose(got.coefficientMatrix.toArray(), want.coefficientMatrix.toArray(), rtol=1e-5, atol=1e-7)
        assert np.allclose(got.interceptVector.toArray(), want.interceptVector.toArray(), rtol=1e-5, atol=1e-7)
        assert got.uid == want.uid and got.extractParamMap() == want.extractParamMap()
        assert got.summary.accuracy == pytest.approx(want.summary.accuracy)


def test_a_step_of_all_folds_is_one_pass(spark, vectors):
    estimator = LogisticRegression(regParam=1e-4, maxIter=12)
    one = estimator.fit(vectors.where("fold is not null and fold <> 0"))
    assert one.summary.totalIterations == 12
    _, n = jobs(spark, "one pass", lambda: models.fit_folds(vectors, 3, estimator))
    assert n < 3 * 12


def test_what_is_not_this_regression_is_fitted_as_before(vectors):
    kinds = [
        LogisticRegression(regParam=0.0), LogisticRegression(regParam=0.1, elasticNetParam=0.5), LogisticRegression(regParam=0.1, fitIntercept=False),
        LogisticRegression(regParam=0.1, standardization=False), LogisticRegression(regParam=0.1, family="binomial"),
    ]
    assert not any(softmax_folds.fits_jointly(k) for k in kinds) and softmax_folds.fits_jointly(LogisticRegression(regParam=0.1))
    two = vectors.where("label < 2")
    estimator = LogisticRegression(regParam=0.01)
    fitted = models.fit_folds(two, 3, estimator)
    for fold, (train, _) in enumerate(fold_pairs(two, 3)):
        assert np.allclose(fitted.models[fold].stages[-1].coefficientMatrix.toArray(), estimator.fit(train).coefficientMatrix.toArray(), atol=1e-7)


def test_classes_that_some_folds_lack(vectors):
    some = vectors.where("label < 3 or fold = 1")  # the run without fold 1 has a class less
    estimator = LogisticRegression(regParam=0.01, maxIter=5)
    fitted = models.fit_folds(some, 3, estimator)
    for fold, (train, _) in enumerate(fold_pairs(some, 3)):
        want, got = estimator.fit(train), fitted.models[fold].stages[-1]
        assert got.numClasses == want.numClasses
        assert np.allclose(got.coefficientMatrix.toArray(), want.coefficientMatrix.toArray(), atol=1e-7)


@pytest.mark.parametrize("values", [[1.0, 200.0], [0.5, -3.0], [1.1, 1e300]])
def test_values_are_kept_exactly(values):
    narrow = softmax_folds._narrow(np.array(values))
    assert narrow.astype(float).tolist() == values
    assert narrow.itemsize == {200.0: 1, -3.0: 4, 1e300: 8}[values[1]]


def test_features_that_are_not_numbers(spark):
    data = [(i % 3, i % 2, Vectors.dense([float(i), float("nan") if i == 7 else 1.0])) for i in range(30)]
    with pytest.raises(Exception, match="NaN"):
        models.fit_folds(spark.createDataFrame(data, SCHEMA), 2, LogisticRegression(regParam=0.1))
