import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import rows
from textpairs.operators import augment, models
from textpairs.plans import inference, training
from textpairs.sources import metrics, shards


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "index bigint, t string")


def test_outcomes_per_row(spark):
    def fn(texts):
        if "bad" in texts:
            raise RuntimeError("refused")
        return ["" if t == "none" else " " if t == "blank" else t.upper() for t in texts]

    got = rows(augment.enrich_column(frame(spark, ["a", "bad", "none", "b", None, "blank"]), "t", fn), "row_index")
    assert got == [(0, "A", "ok"), (1, "", "failed"), (2, "", "empty"), (3, "B", "ok"), (4, "", "failed"), (5, " ", "empty")]


def test_empty_answer_is_asked_once_more(spark, tmp_path):
    seen = str(tmp_path)

    def fn(texts):
        out = []
        for t in texts:
            mark = os.path.join(seen, t)
            out.append("x" if os.path.exists(mark) else "")
            open(mark, "w").close()
        return out

    assert rows(augment.enrich_column(frame(spark, ["q"]).coalesce(1), "t", fn)) == [(0, "x", "ok")]
    assert rows(augment.enrich_column(frame(spark, ["r"]).coalesce(1), "t", fn, retry=0)) == [(0, "", "empty")]


def test_call_size_and_wrong_answer_count(spark):
    sizes = augment.enrich_column(
        frame(spark, ["t"] * 250).coalesce(1), "t", lambda texts: [str(len(texts))] * len(texts)
    )
    assert {r[1] for r in rows(sizes)} == {"99", "52"}
    short = augment.enrich_column(frame(spark, ["t"] * 3), "t", lambda texts: [])
    assert {r[2] for r in rows(short)} == {"failed"}


def test_resume_calls_missing_shards_only(spark, tmp_path):
    path, log = str(tmp_path / "out"), tmp_path / "log"
    log.mkdir()
    df = frame(spark, [f"t{i}" for i in range(40)])
    folder, switch = str(log), str(tmp_path / "on")

    def fn(texts):
        for t in texts:
            if int(t[1:]) >= 20 and not os.path.exists(switch):
                os._exit(1)  # a worker that dies is a failed job, not a failed row
            open(os.path.join(folder, t), "a").write("x")
        return [t.upper() for t in texts]

    options = {"shard_rows": 10, "shards_per_job": 1, "tasks": 1}
    with pytest.raises(Exception):
        augment.enrich_resumable(df, "t", fn, path, "out", **options)
    assert sorted(r[0] for r in rows(shards.read_shards(spark, path, "out").select("row_index"))) == list(range(20))
    open(switch, "w").close()
    done = augment.enrich_resumable(df, "t", fn, path, "out", **options)
    assert rows(done.select("row_index", "text"), "row_index") == [(i, f"T{i}") for i in range(40)]
    assert {len((log / f"t{i}").read_text()) for i in range(40)} == {1}
    names = {r[0] for r in rows(shards.read_shards(spark, path).select("shard").distinct())}
    assert names == {"0-10", "10-20", "20-30", "30-40"}


def test_redo_of_rows_without_text(spark, tmp_path):
    path = str(tmp_path / "out")
    df = frame(spark, ["a", "b", "c"])
    first = augment.enrich_resumable(df, "t", lambda ts: ["" if t == "b" else t for t in ts], path, "out")
    assert rows(first.select("text"), "row_index") == [("a",), ("",), ("c",)]
    assert rows(augment.failed_rows(shards.read_shards(spark, path, "out")).select("row_index")) == [(1,)]
    again = augment.enrich_resumable(df, "t", lambda ts: ["new"] * len(ts), path, "out", redo_empty=True)
    assert rows(again.select("text", "status"), "row_index") == [("a", "ok"), ("new", "ok"), ("c", "ok")]


def test_a_hop_lists_no_shards_of_others(spark, tmp_path):
    def jobs(path, group):
        spark.sparkContext.setJobGroup(group, group)
        df = frame(spark, [f"t{i}" for i in range(80)])
        done = augment.enrich_resumable(df, "t", lambda ts: ts, path, "b", shard_rows=2, shards_per_job=10, tasks=1)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert rows(done.select("row_index", "text"), "row_index") == [(i, f"t{i}") for i in range(80)]
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    crowded = str(tmp_path / "crowded")
    augment.enrich_resumable(frame(spark, ["x"] * 40), "t", lambda ts: ts, crowded, "a", shard_rows=1)
    assert jobs(crowded, "beside 40 shards") == jobs(str(tmp_path / "new"), "alone")


def test_rows_of_a_shard_that_is_there_stay(spark, tmp_path):
    path = str(tmp_path / "out")
    options = {"shard_rows": 4, "shards_per_job": 2}
    df = frame(spark, [f"t{i}" for i in range(20)])
    augment.enrich_resumable(df.where("index % 3 = 0 and index < 12"), "t", lambda ts: ["old"] * len(ts), path, "out", **options)
    done = augment.enrich_resumable(df, "t", lambda ts: ["new"] * len(ts), path, "out", **options)
    want = [(i, "old" if i % 3 == 0 and i < 12 else "new") for i in range(20)]
    assert rows(done.select("row_index", "text"), "row_index") == want


def test_hop_with_a_name_that_folders_escape(spark, tmp_path):
    path = str(tmp_path / "out")
    for hop in ("ko:en/1", "plain"):
        augment.enrich_resumable(frame(spark, [hop]), "t", lambda ts: ts, path, hop)
        assert rows(shards.read_shards(spark, path, hop).select("hop", "text")) == [(hop, hop)]
    assert shards.read_shards(spark, path).count() == 2
    assert shards.read_shards(spark, path, "none").count() == 0


def test_overlapping_shards(spark):
    data = [("out", "0-2", 0, "a", "ok"), ("out", "0-2", 1, "", "failed")]
    data += [("out", "0-4", i, f"w{i}", "ok") for i in range(4)]
    df = spark.createDataFrame(data, "hop string, shard string, row_index bigint, text string, status string")
    assert rows(augment.assemble_hop(df).select("row_index", "text"), "row_index") == [(i, f"w{i}") for i in range(4)]
    parts = augment.union_shards(df.where("shard = '0-2'"), df.where("shard = '0-4' and row_index >= 2"))
    assert rows(augment.assemble_hop(parts).select("row_index", "text"), "row_index") == [(0, "a"), (1, ""), (2, "w2"), (3, "w3")]


def test_round_trip_and_augmented_pairs(spark, tmp_path):
    path = str(tmp_path / "rt")
    data = [(0, "ab", "cd", 1), (1, "ab", "fail", 0), (2, "same", "same", 2), (3, "same", "xy", 2)]
    df = spark.createDataFrame(data, "index bigint, premise string, hypothesis string, label int")

    def fwd(texts):
        return ["" if t == "fail" else t[::-1] for t in texts]

    def back(texts):
        return [" " + t[::-1] if t == "emas" else t[::-1] + "!" for t in texts]

    p = augment.round_trip(df, "premise", fwd, back, path)
    h = augment.round_trip(df, "hypothesis", fwd, back, path)
    assert rows(h, "row_index")[1] == (1, "", "failed")
    got = rows(augment.augmented_pairs(df, p, h), "index")
    assert got == [("rtt", 0, "ab!", "cd!", 1), ("rtt", 3, " same", "xy!", 2)]


def test_changed_texts_are_told_as_before(spark):
    text = [("a  b", "a b"), ("a", "a"), ("a", "b"), (None, "a")]
    data = [(i * 4 + j, *p, *h) for i, p in enumerate(text) for j, h in enumerate(text)]
    df = spark.createDataFrame(data, "index bigint, premise string, _p string, hypothesis string, _h string")
    side = lambda c: df.select(F.col("index").alias("row_index"), F.col(c).alias("text"), F.lit("ok").alias("status"))
    pairs = df.select("index", "premise", "hypothesis", F.lit(1).alias("label"))
    got = rows(augment.augmented_pairs(pairs, side("_p"), side("_h")).select("index"), "index")
    assert got == [(i * 4 + j,) for i in range(4) for j in range(4) if 2 in (i, j)]


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    words = {"contradiction": "no never", "entailment": "yes sure", "neutral": "maybe so"}
    data = [(i, f"text {i}", f"{words[n]} {i % 5}", n) for i, n in enumerate(list(words) * 20)]
    df = spark.createDataFrame(data, "index bigint, premise string, hypothesis string, label string")
    folder = tmp_path_factory.mktemp("models")
    estimator = models.default_estimator(features=64, max_iter=10)
    options = {"tag": "t", "model_path": str(folder / "m"), "metrics_path": str(folder / "metrics")}
    stored, fitted = training.train_folds(df, 3, estimator, **options)
    return df, stored, fitted, folder


def test_fold_models(spark, trained):
    df, stored, fitted, folder = trained
    assert sorted(fitted.models) == [0, 1, 2]
    table = metrics.read_metrics(spark, str(folder / "metrics"))
    assert {r.run for r in table.collect()} == {"t_0", "t_1", "t_2"}
    assert {r.value for r in table.where("metric = 'train_samples'").collect()} == {40.0}
    assert min(r.value for r in table.where("metric = 'accuracy'").collect()) > 0.9
    assert sorted(os.listdir(folder / "m")) == ["t_0", "t_1", "t_2"]
    oof = models.out_of_fold(stored, fitted.models)
    assert oof.count() == 60
    assert oof.where("pred = label").count() > 54


def test_ensemble_of_folds(spark, trained):
    df, stored, fitted, _ = trained
    named = {f"t_{i}": m for i, m in fitted.models.items()}
    long = models.score_ensemble(stored, named)
    assert long.count() == 180 and long.columns == ["model_id", "index", "logits"]
    single = {r["index"]: r.logits for r in models.score(stored, fitted.models[1]).collect()}
    for r in long.where("model_id = 't_1'").collect():
        assert r.logits == pytest.approx(single[r["index"]])
    labels = inference.predict(df, named)
    right = labels.join(df.select("index", "label"), "index").where("pred_label = label").count()
    assert right > 54


def test_user_model_in_batches(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "index bigint, x array<double>")

    def make():
        def predict(x: np.ndarray) -> np.ndarray:
            assert len(x) <= 16
            return np.stack([x[:, 0], x[:, 1], x[:, 0] * 0], axis=1)

        return predict

    got = rows(models.score_batches(df.select("index", F.col("x")), make, ["x"], shapes=[[2]]).select("index", "pred"), "index")
    assert got == [(i, 1 if i == 0 else 0) for i in range(40)]
