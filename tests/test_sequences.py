import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from helpers import one, rows
from textpairs.functions import sequences as seq
from textpairs.functions.masking import mlm_mask
from textpairs.operators.batches import batch_and_pad
from textpairs.operators.spans import enumerate_spans, valid_spans


def test_assembly_and_tail_truncation(spark):
    assert one(spark, seq.assemble_pair("p", "h"), p=[7, 8], h=[9]) == [0, 7, 8, 2, 9, 2]
    cut = one(spark, seq.assemble_pair("p", "h", 8), p=[10, 11, 12, 13, 14], h=[20, 21, 22, 23, 24])
    assert cut == [0, 10, 11, 12, 13, 14, 2, 2]
    long = one(spark, seq.assemble_pair("p", "h", 8), p=list(range(10, 20)), h=[20])
    assert long == [0, 10, 11, 12, 13, 14, 15, 2]
    assert one(spark, seq.first_separator("i"), i=long) == 7


def one_by_one(p, h, budget):
    while p + h > budget:
        if p > h:
            p -= 1
        else:
            h -= 1
    return p, h


def test_longest_first(spark):
    sizes = [(p, h) for p in range(0, 14) for h in range(0, 14)]
    df = spark.createDataFrame([([1] * p, [1] * h) for p, h in sizes], "p array<int>, h array<int>")
    for budget in (1, 2, 5, 8):
        p, h = seq.truncate_longest_first("p", "h", budget + 3)
        got = df.select(F.size("p"), F.size("h"), F.size(p), F.size(h)).collect()
        assert [tuple(r)[2:] for r in got] == [one_by_one(r[0], r[1], budget) for r in got]
    p, h = seq.truncate_longest_first("p", "h", 11)
    assert one(spark, F.array(F.size(p), F.size(h)), p=[1] * 10, h=[1] * 3) == [5, 3]


def test_masks_and_padding(spark):
    assert one(spark, seq.attention_mask("i"), i=[0, 7, 2, 9, 2, 1, 1]) == [1, 1, 1, 1, 1, 0, 0]
    assert one(spark, seq.token_type_ids("p", "h"), p=[7, 8], h=[9]) == [0, 0, 0, 0, 1, 1]
    assert one(spark, seq.pad_fixed("i", 4), i=[5, 6]) == [5, 6, 1, 1]
    with pytest.raises(SparkRuntimeException, match="longer than 6"):
        one(spark, seq.pad_fixed("i", 6), i=[1] * 7)


def test_batches(spark):
    data = [(i * 10, [5] * n) for i, n in enumerate((6, 4, 3, 2, 1))]
    df = spark.createDataFrame(data, "index bigint, input_ids array<int>")
    got = rows(batch_and_pad(df, size=2).select("index", "position", "batch_id", "input_ids"), "index")
    assert [r[:3] for r in got] == [(0, 0, 0), (10, 1, 0), (20, 2, 1), (30, 3, 1), (40, 4, 2)]
    assert got[1][3] == [5] * 4 + [1] * 2
    assert [len(r[3]) for r in got] == [6, 6, 3, 3, 1]
    fixed = rows(batch_and_pad(df, size=2, max_len=8).select("index", F.size("input_ids")), "index")
    assert {r[1] for r in fixed} == {8}


def all_spans(ids, length, size):
    middle = ids.index(2)
    out = []
    for s in range(1, size - 1):
        for e in range(s, size - 1):
            ok = s <= length - 2 and e <= length - 2 and (s > middle or e < middle)
            out.append((s, e, 0 if ok else 1000000))
    return out


CASES = [
    ([0, 7, 8, 2, 9, 2], 6),
    ([0, 7, 8, 2, 9, 2, 1, 1], 6),
    ([0, 2, 9, 2], 4),
    ([0, 7, 2, 2], 4),
    ([0, 2, 2], 3),
    ([0, 7, 8, 9, 2], 5),  # separator cut away
]


@pytest.mark.parametrize("ids, length", CASES)
def test_spans_equal_the_definition(spark, ids, length):
    df = spark.createDataFrame([(1, ids, length)], "k int, input_ids array<int>, length int")
    expected = all_spans(ids, length, len(ids))
    got = rows(enumerate_spans(df, ["k"]), "span_start", "span_end")
    assert [r[1:] for r in got] == expected
    direct = rows(valid_spans(df, ["k"]), "span_start", "span_end")
    assert [r[1:] for r in direct] == [e[:2] for e in expected if e[2] == 0]
    narrow = rows(enumerate_spans(df, ["k"], max_width=1), "span_start", "span_end")
    assert [r[1:] for r in narrow] == [e for e in expected if e[1] - e[0] <= 1]
    direct = rows(valid_spans(df, ["k"], max_width=1), "span_start", "span_end")
    assert [r[1:] for r in direct] == [e[:2] for e in expected if e[2] == 0 and e[1] - e[0] <= 1]


def test_fixture_span_counts(spark):
    for ids, total in (([0, 7, 8, 2, 9, 2], 10), ([0, 7, 8, 2, 9, 2, 1, 1], 21)):
        df = spark.createDataFrame([(1, ids, 6)], "k int, input_ids array<int>, length int")
        table = enumerate_spans(df, ["k"])
        assert (table.count(), table.where("span_mask = 0").count()) == (total, 4)


@settings(max_examples=8, deadline=None)
@given(p=st.integers(0, 8), h=st.integers(0, 8))
def test_span_count_formula(spark, p, h):
    df = spark.createDataFrame([([7] * p, [8] * h)], "p array<int>, h array<int>").withColumn(
        "input_ids", seq.assemble_pair("p", "h")
    ).withColumn("length", F.size("input_ids"))
    assert valid_spans(df, ["length"]).count() == df.select(seq.valid_span_count("p", "h")).first()[0]


def test_mlm_mask(spark):
    df = spark.range(2000).select(
        F.col("id").alias("index"), F.expr("array(0, 7, 8, 2, 9, 10, 11, 12, 2, 1)").cast("array<int>").alias("ids")
    )
    mask = mlm_mask("ids", ["index"], 100)
    masked, labels = mask.getField("masked_id"), mask.getField("label")
    got = df.select("ids", masked.alias("m"), labels.alias("l")).collect()
    picked = [(i, m) for r in got for i, m, lab in zip(r.ids, r.m, r.l) if lab != -100]
    assert all(lab in (-100, i) for r in got for i, lab in zip(r.ids, r.l))
    assert all(i == m for r in got for i, m, lab in zip(r.ids, r.m, r.l) if lab == -100)
    assert all(i > 2 for i, _ in picked)
    assert 0.13 < len(picked) / (2000 * 6) < 0.17
    assert 0.75 < sum(m == 4 for _, m in picked) / len(picked) < 0.85
    again = df.repartition(7).select("index", masked.alias("m")).orderBy("index").collect()
    assert [r.m for r in again] == [r.m for r in got]
    other = df.select(mlm_mask("ids", ["index"], 100, seed=1).getField("masked_id").alias("m")).collect()
    assert [r.m for r in other] != [r.m for r in got]
