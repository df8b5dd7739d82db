"""Missing labels, label types, separators, aligned segments, spans that are not shuffled, numbered corpora."""

import re

import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from textpairs.operators import pooling, rank, sample, split, spans, vocab
from textpairs.plans.corpus import masked_corpus
from textpairs.plans.inference import submission
from textpairs.plans.sequences import encoded_items
from textpairs.plans.training import mixed_folds, mixed_runs
from textpairs.schema import SEP_ID, START_ID
from textpairs.sources.pairs import read_external


@pytest.mark.parametrize("kind", ["smallint", "int", "bigint", "string", "decimal(5,0)", "date"])
def test_missing_labels_are_a_class_of_any_type(spark, kind):
    value = "date_add(date'2020-01-01', int(id % 3))" if kind == "date" else f"cast(id % 3 as {kind})"
    df = spark.range(100).select(F.col("id").alias("index"), F.expr(f"if(id % 5 = 0, null, {value})").alias("label"))
    folded = split.stratified_kfold(df, 5)
    counts = {(r["label"], r["fold"]): r["count"] for r in folded.groupBy("label", "fold").count().collect()}
    assert sum(counts.values()) == 100 and all(counts[None, f] == 4 for f in range(5))
    held = split.holdout_assign(df, 0.5).where("part = 'validation' and label is null")
    assert held.count() == 10
    assert sample.balanced_sample(df, 7).where("label is null").count() == 7


def vocabulary(spark):
    return spark.createDataFrame([("a", 5), ("b", 6), ("c", 7)], "token string, token_id int")


def test_separator_has_its_own_id_and_is_never_drawn(spark):
    lines = spark.createDataFrame([(i, "a b[SEP]c x") for i in range(300)], "index bigint, sentence string")
    out = masked_corpus(lines, vocabulary(spark), p=0.5)
    found = out.collect()
    assert all(r.input_ids == [START_ID, 5, 6, SEP_ID, 7, 3, SEP_ID] for r in found)
    assert all(r.masked_ids[i] == r.input_ids[i] and r.labels[i] == -100 for r in found for i in (0, 3, 6))
    assert {x for r in found for x in r.masked_ids} <= {0, 2, 3, 4, 5, 6, 7}


def test_items_are_aligned(spark):
    pairs = spark.createDataFrame([(0, "a b", "c"), (1, "a " * 200, "b " * 300), (2, "a", "")], "index bigint, premise string, hypothesis string")
    found = {r["index"]: r for r in encoded_items(pairs, vocabulary(spark), max_length=20, size=2).collect()}
    assert found[0].input_ids == [0, 5, 6, 2, 7, 2] + [1] * 14
    assert found[0].attention_mask == [1] * 6 + [0] * 14 and found[0].token_type_ids == [0] * 4 + [1] * 2 + [0] * 14
    assert len(found[1].input_ids) == 20 and found[1].input_ids.count(5) == 9 and found[1].input_ids.count(6) == 8
    for r in found.values():
        assert len(r.input_ids) == len(r.attention_mask) == len(r.token_type_ids)


def test_spans_stay_where_their_sequence_is(spark):
    sequences = spark.range(50).select(F.col("id").alias("row_id"), F.expr("array(0,5,6,2,7,2)").alias("input_ids"), F.lit(6).alias("length"))
    table = spans.enumerate_spans(sequences.repartition("row_id"), ["row_id"])
    scored = pooling.masked_softmax(table.withColumn("score", F.col("span_start") * 1.0).withColumn("vec", F.array(F.lit(1.0))))
    for df in (scored, pooling.weighted_pool(scored), pooling.top_spans(scored, 2)):
        text = plan(df)
        assert len(re.findall(r"^\(\d+\) Exchange", text, re.M)) == 1
    sums = scored.groupBy("row_id").agg(F.sum("weight").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in sums)


@pytest.mark.parametrize("size", [None, 1, 2, 3, 9])
def test_vocabulary_takes_the_most_frequent_words(spark, size):
    df = spark.createDataFrame([("b b b a a", "c d e e")], "premise string, hypothesis string")
    want = [("b", 3, 5), ("a", 2, 6), ("e", 2, 7), ("c", 1, 8), ("d", 1, 9)][:size]
    assert rows(vocab.build_vocab(df, size=size), "token_id") == want


def test_positions_follow_the_rows_in_any_number_of_buckets(spark):
    df = spark.range(0, 1000, 7).select(F.col("id").alias("index"))
    for per_bucket in (10, 100_000):
        found = rows(rank.with_position(df, rows_per_piece=per_bucket), "index")
        assert [p for _, p in found] == list(range(len(found)))
    assert rank.with_position(df.limit(0)).count() == 0


def test_corpus_without_index_is_numbered_by_its_rows(spark, tmp_path):
    pairs = [("a", "b", "neutral"), ("a", "b", "neutral"), ("c", None, "neutral"), ("", "b", None)]
    df = spark.createDataFrame(pairs, "premise string, hypothesis string, label string")
    found = []
    for i, parts in enumerate((1, 3)):
        df.repartition(parts).write.parquet(f"{tmp_path}/{i}")
        found.append(rows(read_external(spark, f"{tmp_path}/{i}", "parquet"), "index"))
    assert found[0] == found[1] and [r[0] for r in found[0]] == [0, 1, 2, 3]


def test_extra_rows_train_only(spark):
    folded = spark.range(10).select(F.col("id").alias("index"), F.lit("p").alias("premise"), F.lit("h").alias("hypothesis"), F.lit(1).alias("label"), (F.col("id") % 2).cast("int").alias("fold"))
    derived = spark.range(5, 15).select(F.col("id").alias("index"), F.lit("x").alias("premise"), F.lit("y").alias("hypothesis"), F.lit(1).alias("label"))
    runs = mixed_runs(mixed_folds(folded, {"other": derived}, {"trip": derived}), 2)
    counts = {(r.run, r.part, r.source): r["count"] for r in runs.groupBy("run", "part", "source").count().collect()}
    assert counts == {
        **{(r, p, "train"): 5 for r in (0, 1) for p in ("train", "validation")},
        **{(r, "train", "other"): 10 for r in (0, 1)},
        (0, "train", "trip"): 3,
        (1, "train", "trip"): 2,
    }
    held = {r["index"] for r in runs.where("run = 0 and part = 'validation'").collect()}
    assert not held & {r["index"] for r in runs.where("run = 0 and source = 'trip'").collect()}


def test_submission_leaves_rows_without_text_open(spark):
    from textpairs.operators.models import bayes_estimator

    train = spark.createDataFrame([("a b c", "a", 0), ("a", "b c d e", 1), ("x y", "x y", 2)], "premise string, hypothesis string, label int")
    model = bayes_estimator().fit(train)
    asked = spark.createDataFrame([(1, "a b c d", "a"), (2, "a", None)], "index bigint, premise string, hypothesis string")
    found = dict(rows(submission(asked.select("index", F.lit("").alias("label")), asked, {"m": model}), "index"))
    assert found == {1: "contradiction", 2: None}


def test_rows_without_key_are_no_duplicates(spark):
    from textpairs.operators.dedup import dedup_keep_first

    df = spark.createDataFrame([(1, "x"), (2, None), (3, "x"), (4, None)], "index bigint, t string")
    assert rows(dedup_keep_first(df, "t").select("index"), "index") == [(1,), (2,), (4,)]


def test_positions_in_a_mixed_corpus(spark):
    one, two = (spark.range(n).select(F.col("id").alias("index"), F.lit("p").alias("premise"), F.lit("h").alias("hypothesis"), F.lit(0).alias("label")) for n in (30, 20))
    mixed = sample.mix(b=one, a=two)
    found = rank.with_position(mixed, ["source", "index"], rows_per_piece=7)
    got = sorted((r["source"], r["index"], r["position"]) for r in found.collect())
    assert [p for _, _, p in got] == list(range(50))
