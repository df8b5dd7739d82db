"""Span softmax over blocks of starts against the plain softmax of a row."""

import math
import random
import re

import numpy as np
import pytest
from helpers import plan
from pyspark.sql import functions as F

from textpairs.operators import spans
from textpairs.operators.attention import SpanAttention

SCORES = {
    "small": "((coalesce(row_id, 0) * 7 + span_start * 3 + span_end * 5) % 11) / 4.0",
    "wide": "(span_start * 37 + span_end * 91) % 1000 * 3.7D - 2000",
    "huge": "(span_start - span_end) * 1e7D",
    "equal": "3.0D",
    "odd": "case when span_start % 5 = 0 then null when span_end % 7 = 0 then double('-infinity') when span_end % 6 = 0 then double('NaN') else span_end * 0.3 end",
}


def sequences(spark, lengths):
    """Ids of a pair with a separator near the middle; the last row has no id."""
    rows = [(i if i < len(lengths) - 1 else None, [0] + [5] * (n // 2) + [2] + [6] * (n - n // 2) + [2], n + 3) for i, n in enumerate(lengths)]
    return spark.createDataFrame(rows, "row_id bigint, input_ids array<int>, length int")


def attention(spark, lengths, score, size=50):
    def scored(blocks, keep):
        made = spans.spans_of(blocks, keep).withColumn("score", F.expr(SCORES[score]))
        return made.withColumn("vec", F.expr("array(span_start / 10D, span_end * 1D, 1D)"))

    return SpanAttention(spans.span_blocks(sequences(spark, lengths), ["row_id"], size=size), scored)


LENGTHS = [0, 1, 2, 9, 30, 41, 17]


def plain(spark, score):
    """Spans and weights per row, by the definition."""
    table = spans.enumerate_spans(sequences(spark, LENGTHS), ["row_id"]).withColumn("score", F.expr(SCORES[score]))
    out = {}
    for r in table.collect():
        x = None if r.score is None or math.isnan(r.score) else float(r.score) - r.span_mask
        out.setdefault(r.row_id, []).append((r.span_start, r.span_end, x))
    for row, found in out.items():
        top = max((x for *_, x in found if x is not None), default=0.0)
        e = [None if x is None else math.exp(x - top) for *_, x in found]
        total = sum(x for x in e if x is not None)
        out[row] = sorted((s, t, x, None if w is None else w / total) for (s, t, x), w in zip(found, e))
    return out


@pytest.mark.parametrize("score", SCORES)
@pytest.mark.parametrize("size", [1, 50, 10**6])
def test_weights(spark, score, size):
    want = plain(spark, score)
    found = {}
    for r in attention(spark, LENGTHS, score, size).weights().collect():
        found.setdefault(r.row_id, []).append((r.span_start, r.span_end, r.weight))
    assert set(found) == set(want)
    for row, mine in found.items():
        mine.sort()
        assert [m[:2] for m in mine] == [w[:2] for w in want[row]]
        assert [m[2] is None for m in mine] == [w[3] is None for w in want[row]]
        assert [m[2] or 0 for m in mine] == pytest.approx([w[3] or 0 for w in want[row]], rel=1e-6, abs=1e-12)


@pytest.mark.parametrize("score", SCORES)
def test_pool_squares_and_top(spark, score):
    want, made = plain(spark, score), attention(spark, LENGTHS, score)
    pooled = {r.row_id: r.pooled for r in made.pool("vec", 3).collect()}
    squares = {r.row_id: r.squares for r in made.squares().collect()}
    for row, found in want.items():
        weights = [(s, t, w or 0.0) for s, t, _, w in found]
        vec = np.array([[s / 10, t, 1.0] for s, t, _ in weights])
        assert pooled[row] == pytest.approx((np.array([w for *_, w in weights])[:, None] * vec).sum(axis=0).tolist(), rel=1e-6)
        assert squares[row] == pytest.approx(sum(w * w for *_, w in weights), rel=1e-6)
    assert made.regulariser(2.0).first()["regulariser"] == pytest.approx(2 * np.mean(list(squares.values())))
    for n in (1, 5, 40):
        top = {}
        for r in made.top(n).collect():
            top.setdefault(r.row_id, []).append((r["rank"], r.span_start, r.span_end))
        for row, found in want.items():
            order = sorted(((-x, s, t) for s, t, x, _ in found if x is not None))[:n]
            assert sorted(top[row]) == [(i + 1, s, t) for i, (_, s, t) in enumerate(order)]


def test_spans_lie_in_many_tasks_and_are_not_sorted(spark):
    made = attention(spark, [200, 3, 300], "small", size=2000)
    blocks = spans.deal_blocks(made.blocks, "row_id")
    sizes = spans.spans_of(blocks, ["row_id"]).groupBy(F.spark_partition_id()).count().collect()
    cores = spark.sparkContext.defaultParallelism
    assert len(sizes) >= cores and max(r["count"] for r in sizes) < sum(r["count"] for r in sizes) / 2
    for df in (made.weights(), made.pool("vec", 3), made.squares(), made.top(5)):
        text = plan(df)
        assert not re.search(r"\) (Sort|Window|SortAggregate|SortMergeJoin)\b", text)
    assert spans.deal_blocks(made.blocks, "row_id", task_spans=1000).rdd.getNumPartitions() > 20


def test_blocks_hold_every_span_once(spark):
    rng = random.Random(1)
    frame = sequences(spark, [rng.randrange(60) for _ in range(12)])
    want = sorted(map(repr, map(tuple, spans.enumerate_spans(frame, ["row_id"]).collect())))
    for size in (1, 37, 10**9):
        blocks = spans.span_blocks(frame, ["row_id"], size=size)
        assert sorted(map(repr, map(tuple, spans.spans_of(blocks, ["row_id"]).collect()))) == want
    assert spans.deal_blocks(spans.span_blocks(frame.where("false"), ["row_id"]), "row_id").count() == 0
