import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helpers import plan, rows, runs_python
from textpairs.operators import rank, sample, split
from textpairs.operators.dedup import dedup_keep_first

LABELS = [0] * 50 + [1] * 46 + [2] * 47


def h(seed, key):
    return int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:8], 16)


@pytest.fixture(scope="module")
def labelled(spark):
    data = [(i * 7 + 3, label) for i, label in enumerate(LABELS)]
    return spark.createDataFrame(data, "index bigint, label int").cache()


def test_fold_counts(labelled):
    folded = rows(split.stratified_kfold(labelled, 5), "index")
    assert len(folded) == len({r[0] for r in folded}) == 143
    counts = Counter((r[1], r[2]) for r in folded)
    assert [counts[0, f] for f in range(5)] == [10] * 5
    assert [counts[1, f] for f in range(5)] == [10, 9, 9, 9, 9]
    assert [counts[2, f] for f in range(5)] == [9, 10, 10, 9, 9]
    sizes = Counter(r[2] for r in folded)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for label in (0, 1, 2):  # runs in hash order
        mine = sorted((h(42, r[0]), r[0], r[2]) for r in folded if r[1] == label)
        assert [m[2] for m in mine] == sorted(m[2] for m in mine)


def outcomes(df):
    return (
        rows(split.stratified_kfold(df, 5), "index"),
        rows(rank.seeded_shuffle(df).select("index", "position"), "index"),
        rows(split.holdout_assign(df, 0.2), "index"),
        rows(sample.balanced_sample(df, 7).select("index"), "index"),
    )


@pytest.fixture(scope="module")
def expected(labelled):
    return outcomes(labelled)


@pytest.mark.parametrize("parts, adaptive", [(1, "true"), (4, "false"), (13, "true")])
def test_results_do_not_depend_on_the_layout(spark, labelled, expected, parts, adaptive):
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        assert outcomes(labelled.repartition(parts)) == expected
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def test_shuffle_is_the_hash_order(expected):
    order = sorted((h(42, key), key) for key, _ in expected[1])
    assert {key: i for i, (_, key) in enumerate(order)} == dict(expected[1])


@pytest.mark.parametrize("bits", [1, 20])
def test_bucket_count_changes_nothing(labelled, expected, bits):
    assert rows(split.stratified_kfold(labelled, 5, bits=bits), "index") == expected[0]
    assert rows(rank.seeded_shuffle(labelled, bits=bits).select("index", "position"), "index") == expected[1]


def test_small_labels_and_bad_k(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(7)] + [(9, 2)], "index bigint, label int")
    folded = rows(split.stratified_kfold(df, 3), "index")
    assert len(folded) == 8 and {r[2] for r in folded} == {0, 1, 2}
    with pytest.raises(ValueError):
        split.stratified_kfold(df, 1)
    with pytest.raises(ValueError):
        split.stratified_kfold(df, 5)


def test_fold_views(labelled):
    folded = split.stratified_kfold(labelled, 5)
    views = split.fold_pairs(folded, 5)
    assert sum(v.validation.count() for v in views) == 143
    assert all(v.train.count() + v.validation.count() == 143 for v in views)
    long = split.fold_pairs_long(folded, 5)
    assert long.count() == 5 * 143
    assert long.where("part = 'validation'").count() == 143


def test_holdout_counts(spark):
    df = spark.createDataFrame([(i, 0) for i in range(7)] + [(i, 1) for i in range(7, 11)], "index bigint, label int")
    train, validation = split.stratified_holdout(df, 0.2)
    assert Counter(r[1] for r in rows(validation)) == {0: 1}
    assert train.count() == 10
    keep = sorted(range(7), key=lambda i: (h(42, i), i))[0]
    assert rows(validation.select("index")) == [(keep,)]
    assert split.stratified_holdout(df, 1.0).train.count() == 0


def test_dispatch(labelled):
    assert len(split.split(labelled, k_fold=4, val_ratio=0.5)) == 4
    assert len(split.split(labelled, k_fold=4, val_ratio=0.5, train=False)) == 1
    assert split.split(labelled, train=False) is labelled
    [(train, validation)] = split.split(labelled)
    assert (train.count(), validation.count()) == (143, 0)


def test_string_labels_and_compound_keys(spark):
    data = [("a" if i % 3 else "b", i // 2, "x" if i % 2 else "y") for i in range(40)]
    df = spark.createDataFrame(data, "source string, index bigint, label string")
    folded = rows(split.stratified_kfold(df, 4, key=["source", "index"]), "source", "index")
    assert set(Counter(r[3] for r in folded).values()) == {10}
    taken = rows(sample.balanced_sample(df, 3, key=["source", "index"]))
    assert Counter(r[2] for r in taken) == {"x": 3, "y": 3}


@pytest.mark.parametrize("index", [range(0, 5000, 5), [i**3 for i in range(1000)], [2**61 + i for i in range(1000)]])
def test_source_positions(spark, index):
    df = spark.createDataFrame([(i,) for i in index], "index bigint").repartition(5)
    got = rows(rank.with_position(df, rows_per_piece=100), "index")
    assert got == [(i, n) for n, i in enumerate(sorted(index))]


def test_balanced_sample_takes_whole_small_labels(spark, labelled):
    assert Counter(r[1] for r in rows(sample.balanced_sample(labelled, 47))) == {0: 47, 1: 46, 2: 47}


def test_form_quotas():
    assert sample.form_quotas({(0, 0): 1, (0, 1): 1, (1, 0): 1}, 10) == {(0, 0): 4, (0, 1): 3, (1, 0): 3}
    assert sample.form_quotas({(0, 0): 3, (5, 0): 1}, 4) == {(0, 0): 3, (5, 0): 1}
    assert sample.form_quotas({}, 4) == {}


def test_sample_like(spark):
    pool = [(i, "p" * (5 if i % 2 else 25), "h", i % 3) for i in range(120)]
    schema = "index bigint, premise string, hypothesis string, label int"
    df = spark.createDataFrame(pool, schema)
    target = spark.createDataFrame([(i, "q" * (5 if i < 3 else 25), "z", 3) for i in range(4)], schema)
    got = rows(sample.sample_like(df, target, 8))
    assert Counter((r[3], len(r[1])) for r in got) == {(c, n): q for c in range(3) for n, q in ((5, 6), (25, 2))}
    short = rows(sample.sample_like(df, target, 80))  # bins give what they have
    assert Counter(len(r[1]) for r in short) == {5: 60, 25: 60}


def test_dedup_keeps_the_first(spark):
    data = [(5, "a", "b"), (2, "a", "b"), (9, "a", "b"), (1, "a[SEP]b", "c"), (3, "a", "b[SEP]c"), (4, "x", "y")]
    df = spark.createDataFrame(data, "index bigint, premise string, hypothesis string").repartition(3)
    assert [r[0] for r in rows(dedup_keep_first(df), "index")] == [1, 2, 4]


def test_dedup_with_one_hot_text(spark):
    df = spark.range(3000).select(
        F.col("id").alias("index"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("premise"),
        F.lit("h").alias("hypothesis"),
    ).repartition(6)
    got = dedup_keep_first(df)
    assert got.count() == 2001
    assert got.where("premise = 'hot'").first()["index"] == 0


def test_dedup_cuts_duplicates_before_the_exchange(spark, labelled):
    df = labelled.withColumn("premise", F.col("index").cast("string")).withColumn("hypothesis", F.lit("h"))
    text = plan(dedup_keep_first(df))
    assert text.count("WindowGroupLimit") >= 2 and "Partial" in text


def test_final_passes_move_no_rows(labelled):
    done = (
        split.stratified_kfold(labelled, 5),
        split.holdout_assign(labelled, 0.2),
        sample.balanced_sample(labelled, 5),
    )
    for out in done:
        text = plan(out)
        assert "hashpartitioning" not in text and "SinglePartition" not in text and not runs_python(out)
