"""Spans as intervals of ends, overlaps as intervals of shards: the same rows as without intervals."""

import random
import re

import pytest
from helpers import plan
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textpairs.functions.text import is_empty_result
from textpairs.operators import augment, spans


def content(df, *columns):
    return sorted(map(repr, map(tuple, df.select(*columns).collect())))


@pytest.mark.parametrize("seed", range(3))
def test_intervals_are_the_spans(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        p, h, padding = rng.randrange(6), rng.randrange(6), rng.randrange(5)
        ids = [0] + [5] * p + ([2] if rng.random() < 0.8 else []) + [6] * h + [2] + [1] * padding
        rows.append((i, ids, len(ids) - padding))
    rows += [(100, [0, 2], 2), (101, [0], 1), (102, [2], 1), (103, [0, 2, 2], 3)]
    df = spark.createDataFrame(rows, "index bigint, input_ids array<int>, length int")
    names = ["index", "span_start", "span_end", "span_mask"]
    intervals = spans.span_intervals(df, ["index"])
    assert content(spans.expand_intervals(intervals), *names) == content(spans.enumerate_spans(df, ["index"]), *names)
    assert intervals.groupBy("index", "span_start").count().agg(F.max("count")).first()[0] <= 2
    assert intervals.where("first_end > last_end").count() == 0


SHARD = "hop string, shard string, row_index bigint, text string, status string"


def ranked(shards):
    """Every row ranked, without intervals."""
    bounds = F.split("shard", "-")
    width = bounds[1].cast("bigint") - bounds[0].cast("bigint")
    best = W.partitionBy("hop", "row_index").orderBy(is_empty_result("text").asc(), width.desc(), F.asc("shard"), F.asc("text"))
    return shards.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")


@pytest.mark.parametrize("seed", range(3))
def test_overlaps_are_resolved_where_they_are(spark, seed):
    rng = random.Random(seed)
    rows = []
    for hop in ("out", "back"):
        for _ in range(12):
            start = rng.randrange(0, 200)
            stop = start + rng.randrange(1, 40)
            for i in range(start, stop):
                for _ in range(2 if rng.random() < 0.02 else 1):
                    rows.append((hop, f"{start}-{stop}", i, rng.choice(["", " ", "x", "y", None]), "ok"))
    shards = spark.createDataFrame(rows, SHARD).repartition(3)
    assert content(augment.resolve_overlap(shards), *shards.columns) == content(ranked(shards), *shards.columns)


def test_texts_of_other_intervals_do_not_move(spark, tmp_path):
    rows = [("out", "0-50", i, f"a{i}", "ok") for i in range(50)] + [("out", "45-90", i, f"b{i}", "ok") for i in range(45, 90)]
    rows += [("out", "200-210", i, "", "ok") for i in range(200, 210)] + [("back", "0-90", i, "c", "ok") for i in range(90)]
    spark.createDataFrame(rows, SHARD).write.partitionBy("hop", "shard").parquet(f"{tmp_path}/s")
    shards = spark.read.schema(SHARD).parquet(f"{tmp_path}/s")
    crowded = {(r.hop, r.shard): [tuple(c) for c in r.crowded] for r in augment.crowded_intervals(shards).collect()}
    assert crowded == {("out", "0-50"): [(45, 50)], ("out", "45-90"): [(45, 50)]}
    found = augment.resolve_overlap(shards)
    assert content(found, *shards.columns) == content(ranked(shards), *shards.columns)
    text = plan(found)
    assert len(re.findall(r"^\(\d+\) Exchange", text, re.M)) == len(re.findall(r"^\(\d+\) Window\b", text, re.M)) == 1
    assert re.search(r"Filter\n[^\n]*\nCondition : [^\n]*exists", text)
    apart = augment.resolve_overlap(shards.where("hop = 'back' or shard = '0-50'"))
    assert "Exchange" not in plan(apart) and apart.count() == 140


def test_no_shards(spark):
    assert augment.resolve_overlap(spark.createDataFrame([], SHARD)).count() == 0
