import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import one, plan, rows, runs_python
from textpairs.functions import scores as fn
from textpairs.operators import pooling, scoring


def softmax(x):
    e = np.exp(np.asarray(x) - max(x))
    return e / e.sum()


def test_softmax_and_argmax(spark):
    for x in ([1.0, 2.0, 3.0], [1000.0, 0.0, -1000.0], [0.0, 0.0, 0.0]):
        got = one(spark, fn.softmax("a"), a=x)
        assert got == pytest.approx(list(softmax(x))) and sum(got) == pytest.approx(1)
    assert one(spark, fn.argmax("a"), a=[1.0, 3.0, 3.0]) == 1


def test_two_ensemble_paths_differ(spark):
    models = [[10.0, 0.0, -9.0], [-1.0, 1.0, -9.0], [-1.0, 1.0, -9.0]]
    df = spark.createDataFrame([(m, 1, x) for m, x in enumerate(models)], "model_id int, row_id bigint, logits array<double>")
    assert rows(scoring.ensemble_labels(df)) == [(1, "contradiction")]
    [(_, probs)] = rows(scoring.ensemble_probs(df))
    assert probs == pytest.approx([0.413, 0.587, 0.0], abs=1e-3)
    [(_, label, both)] = rows(scoring.ensemble(df))
    assert label == "contradiction" and both == probs
    text = plan(scoring.ensemble(df))
    assert "collect_list" not in text and "HashAggregate" in text and not runs_python(scoring.ensemble(df))


def test_losses(spark):
    data = [([1.0, 2.0, 0.5], 1), ([0.0, -3.0, 4.0], 0), ([2.0, 2.0, 2.0], 2)]
    df = spark.createDataFrame(data, "logits array<double>, gold int")
    nll = [-math.log(softmax(x)[y]) for x, y in data]
    uniform = [-np.log(softmax(x)).mean() for x, _ in data]
    assert scoring.cross_entropy(df).first()["loss"] == pytest.approx(np.mean(nll))
    mixed = np.mean([0.8 * a + 0.2 * b for a, b in zip(nll, uniform)])
    assert scoring.smoothed_cross_entropy(df).first()["loss"] == pytest.approx(mixed)


def test_accuracy(spark):
    df = spark.createDataFrame([(0, 0, "a"), (1, 2, "a"), (2, 2, "b")], "pred int, gold int, part string")
    assert rows(scoring.accuracy(df)) == [(pytest.approx(2 / 3), 3)]
    assert rows(scoring.accuracy_by_part(df), "part") == [("a", 0.5, 2), ("b", 1.0, 1)]


def test_best_checkpoint(spark):
    data = [("r", 500, "accuracy", 0.8), ("r", 1000, "accuracy", 0.9), ("r", 1500, "accuracy", 0.9), ("r", 2, "loss", 9.0), ("s", 1, "accuracy", 0.1), ("s", 2, "accuracy", None)]
    df = spark.createDataFrame(data, "run string, step bigint, metric string, value double")
    assert rows(scoring.best_checkpoint(df), "run") == [("r", 1000, 0.9), ("s", 1, 0.1)]


@pytest.fixture(scope="module")
def spans(spark):
    data = [(1, s, e, float((3 * s + e) % 5), 0 if s == e else 1000000, [float(s), float(e)]) for s in range(1, 5) for e in range(s, 5)]
    data += [(2, s, s, float(s), 1000000, [1.0, float(s)]) for s in range(1, 4)]  # every span masked
    return spark.createDataFrame(data, "row_id bigint, span_start int, span_end int, score double, span_mask int, vec array<double>")


def test_masked_softmax_pool_and_top(spark, spans):
    weighted = pooling.masked_softmax(spans)
    got = rows(weighted, "row_id", "span_start", "span_end")
    for row in (1, 2):
        mine = [r for r in got if r[0] == row]
        expected = softmax([r[3] - r[4] for r in mine])
        assert [r[6] for r in mine] == pytest.approx(list(expected))
    pooled = dict(rows(pooling.weighted_pool(weighted)))
    for row in (1, 2):
        mine = [r for r in got if r[0] == row]
        assert pooled[row] == pytest.approx(list(sum(r[6] * np.array(r[5]) for r in mine)))
    best = rows(pooling.top_spans(weighted, 2).select("row_id", "rank", "span_start"), "row_id", "rank")
    assert [r[:2] for r in best] == [(1, 1), (1, 2), (2, 1), (2, 2)] and best[2][2] == 3
    squares = {row: sum(r[6] ** 2 for r in got if r[0] == row) for row in (1, 2)}
    reg = pooling.span_regulariser(weighted, 2.0).first()["regulariser"]
    assert reg == pytest.approx(2.0 * sum(squares.values()) / 2)
    assert "WindowGroupLimit" in plan(pooling.top_spans(weighted, 2))


def test_concat_last_layers(spark):
    data = [(1, layer, [float(layer), layer + 0.5]) for layer in range(7)] + [(2, 0, [9.0, 9.5])]
    df = spark.createDataFrame(data, "row_id bigint, layer int, vec array<double>").repartition(5)
    assert rows(pooling.concat_last_layers(df), "row_id") == [(1, [6.0, 6.5, 5.0, 5.5, 4.0, 4.5, 3.0, 3.5]), (2, [9.0, 9.5])]


def test_label_outside_the_classes_is_an_error(spark):
    df = spark.createDataFrame([([1.0, 2.0, 0.5], 3)], "logits array<double>, gold int")
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):
        df.select(F.sum(fn.negative_log_likelihood("logits", "gold"))).collect()
