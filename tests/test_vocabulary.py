"""Vocabulary of any size: exact ranks in pieces, lookups that are dealt out, positions by any key."""

import random
import re
import statistics

import numpy as np
import pyarrow as pa
import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

import __spark_entry__ as driver
from textpairs import storage
from textpairs.operators import rank, vocab
from textpairs.schema import UNKNOWN_ID


def pairs(spark, data):
    return spark.createDataFrame(data, "index bigint, premise string, hypothesis string")


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(400)}" if i % 3 else f"rare{i}" for i in range(4000)]
    data = [(i, " ".join(words[20 * i : 20 * i + 12]), " ".join(words[20 * i + 12 : 20 * i + 20])) for i in range(200)]
    return pairs(spark, [*data, (200, None, "w1 unheard w2"), (201, "", None), (202, "<sep> w3", "w3 " * 300)])


def test_words_of_one_count_are_ranked_in_many_tasks(spark):
    data = [(0, " ".join(f"once{i:05d}" for i in range(20_000)), "twice twice")]
    found = vocab.build_vocab(pairs(spark, data), size=None)
    assert found.orderBy("token_id").limit(3).collect() == [("twice", 2, 5), ("once00000", 1, 6), ("once00001", 1, 7)]
    assert found.agg(F.max("token_id"), F.count("*")).first() == (20_005, 20_001)
    stored = storage.materialise(found)
    sizes = []
    ranked = rank.with_position(stored.select("token", "token_count"), [F.desc("token_count"), "token"], rows_per_piece=1000)
    for r in ranked.groupBy(F.floor(F.col("position") / 1000)).count().collect():
        sizes.append(r["count"])
    assert max(sizes) < 3 * statistics.median(sizes)
    assert not re.search(r"windowspecdefinition\(token_count", plan(found))


def test_pieces_are_even(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(rank, "materialise", lambda df: kept.append(storage.materialise(df)) or kept[-1])
    data = spark.range(50_000).select(F.md5(F.col("id").cast("string")).alias("token"), F.lit(1).alias("token_count"))
    rank.with_position(data, [F.desc("token_count"), "token"], rows_per_piece=2000).count()
    sizes = [r["count"] for r in kept[0].groupBy(F.shiftright("_at", rank.PIECE_BITS)).count().collect()]
    assert len(sizes) >= 20 and max(sizes) < 3 * statistics.median(sizes)


@pytest.mark.parametrize("limit", [0, 7, 1000])
def test_a_large_vocabulary_stays_dealt_out(spark, corpus, monkeypatch, limit):
    known = storage.materialise(vocab.build_vocab(corpus.where("index < 150"), size=None))
    columns = {"premise": "p", "hypothesis": "h"}
    want = rows(vocab.encode_texts(corpus, columns, known, specials={"<sep>": 2}), "index")
    assert any(UNKNOWN_ID in r[3] for r in want if r[3])
    monkeypatch.setattr(vocab, "MAX_VOCABULARY", limit)
    found = vocab.encode_texts(corpus.repartition(3), columns, known, specials={"<sep>": 2})
    assert found.columns == [*corpus.columns, "p", "h"] and rows(found, "index") == want
    dealt = re.findall(r"Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan(found))
    assert dealt and not any("premise" in columns or "_words" in columns for columns in dealt)


def test_blocks_of_few_rows(spark, corpus, monkeypatch):
    known = storage.materialise(vocab.build_vocab(corpus, size=None))
    want = rows(vocab.encode_texts(corpus, {"premise": "p"}, known), "index")
    monkeypatch.setattr(vocab, "MAX_VOCABULARY", 5)
    monkeypatch.setattr(vocab, "BLOCK_BITS", 2)
    assert rows(vocab.encode_texts(corpus, {"premise": "p"}, known), "index") == want
    assert vocab.encode_texts(corpus.where("false"), {"premise": "p"}, known).count() == 0


def test_encoded_pairs_with_a_large_vocabulary(spark, sf_dir, monkeypatch):
    want = rows(driver.queries()["encoded_pairs"](spark, sf_dir), "index")
    monkeypatch.setattr(vocab, "MAX_VOCABULARY", 1000)
    assert rows(driver.queries()["encoded_pairs"](spark, sf_dir), "index") == want


@pytest.mark.parametrize("per_piece", [1, 50, 10**6])
def test_positions_by_any_key(spark, per_piece):
    rng = random.Random(2)
    numbers = [*range(1000, 1400), -(2**62), 2**62, *(rng.randrange(10**9) for _ in range(100))]
    rng.shuffle(numbers)
    df = spark.createDataFrame([(i, f"k{i}", i / 3) for i in numbers], "index bigint, name string, part double").repartition(7)
    per_piece = max(per_piece, 20)
    for order, key in (("index", lambda r: r[0]), (["name"], lambda r: r[1]), ([F.desc("part"), "index"], lambda r: (-r[2], r[0]))):
        found = sorted(map(tuple, rank.with_position(df, order, rows_per_piece=per_piece).collect()), key=lambda r: r[3])
        assert [r[:3] for r in found] == sorted(((i, f"k{i}", i / 3) for i in numbers), key=key)
        assert [r[3] for r in found] == list(range(len(numbers)))


def test_plan_of_positions_does_not_grow(spark):
    sizes = [len(plan(rank.with_position(spark.range(n).withColumnRenamed("id", "index"), rows_per_piece=50))) for n in (100, 10_000)]
    assert abs(sizes[1] - sizes[0]) < 300


def test_release_drops_tables(spark, tmp_path):
    before = {t.name for t in spark.catalog.listTables()}
    stored = dict(storage._STORED), dict(storage._TABLES)
    storage._STORED.clear()
    storage._TABLES.clear()
    table = storage.materialise_bucketed(spark.range(10), 2, "id")
    path = table.inputFiles()[0]
    assert {t.name for t in spark.catalog.listTables()} != before
    storage.release(spark)
    assert {t.name for t in spark.catalog.listTables()} == before
    from pathlib import Path

    assert not Path(path.removeprefix("file://")).exists()
    storage._STORED.update(stored[0])
    storage._TABLES.update(stored[1])


@pytest.mark.parametrize("hashes", [None, lambda texts: np.arange(len(texts), dtype=np.uint64) // 3 * 0, lambda texts: np.array([len(t.as_py()) for t in texts], np.uint64)])
def test_word_indexes_are_exact_whatever_the_hashes(monkeypatch, hashes):
    if hashes:
        monkeypatch.setattr(vocab, "_hashes", hashes)
    known = ["a", "b", "", "한국", "a" * 300, None, "twice", "b\0", "twice", "<sep>", "no id"]
    ids = [5, 6, 7, 8, 9, 10, 11, 12, 13, 14, None]
    index = vocab.WordIndex(pa.array(known), pa.array(ids, pa.int32()), 3, {"<sep>": 2, "own": 1})
    asked = ["x", "own", "<sep>", "no id", "twice", "b\0", "a" * 300, "a" * 299, "", "한국", "한", "b", "a", "\0"]
    assert index.look_up(pa.array(["skipped", *asked])[1:]).to_pylist() == [3, 1, 2, 3, 13, 12, 9, 3, 7, 8, 3, 6, 5, 3]
    assert index.look_up(pa.array([], pa.string())).to_pylist() == []
    empty = vocab.WordIndex(pa.array([], pa.string()), pa.array([], pa.int32()), 3, {"own": 1})
    assert empty.look_up(pa.array(["own", "x"])).to_pylist() == [1, 3]


def test_a_word_index_is_a_few_bytes_a_word():
    n = 200_000
    index = vocab.WordIndex(pa.array([f"word{i}" for i in range(n)]), pa.array(range(n), pa.int32()), 3)
    size = index.hashes.nbytes + index.ids.nbytes + index.words.nbytes
    assert not index.rest and size < 40 * n
