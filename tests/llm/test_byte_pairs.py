"""The byte-pair encoder: what it remembers, and pieces of any length against the merges."""

import random

import public_tokenizers
import pyarrow as pa
import pytest

from textpairs.llm.byte_bpe import RANKS, BytePairs, encode_documents, read_ranks


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(public_tokenizers.path(RANKS))


def test_a_piece_that_keeps_coming_is_encoded_once(ranks):
    pairs, met = BytePairs(ranks, cached=100), []
    encode = pairs.encode_piece
    pairs.encode_piece = lambda piece: met.append(piece) or encode(piece)
    for i in range(1000):
        pairs.encode([" recurringpiece", f" rare{i}x{i}"])
    assert met.count(b" recurringpiece") == 1
    assert len(pairs.pieces) + len(pairs.pieces.before) <= 100 + 1


def test_merges_take_the_lowest_rank_first_and_the_left_one_of_equals(ranks):
    pairs, draw = BytePairs(ranks), random.Random(5)

    def plain(data):
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 62))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [ranks[p] for p in parts]

    for _ in range(2000):
        data = bytes(draw.choices(b"aeinrst \xed\x95\x9c0", k=draw.randrange(0, 24)))
        assert pairs.merged(data) == plain(data), data


def test_pieces_of_any_length_are_encoded_as_the_merges(ranks):
    draw, pairs = random.Random(6), BytePairs(ranks)
    pieces = [bytes(draw.choices(b"aeinrst \xed\x95\x9c0", k=draw.randrange(1, 60))) for _ in range(1000)]
    pieces += [b"a" * 3000, b" " * 3000, b"abcde " * 500, "한".encode() * 500]
    assert [pairs.encode_piece(p) for p in pieces] == [pairs.merged(p) for p in pieces]


def test_workers_keep_nothing_remembered(spark):
    def held(batches):
        import gc

        list(batches)
        gc.collect()
        yield pa.RecordBatch.from_pylist([{"n": sum(len(o.pieces) + len(o.pairs) for o in gc.get_objects() if type(o).__name__ == "BytePairs")}])

    docs = spark.createDataFrame([(i, f"some text {i}") for i in range(40)], "doc_id bigint, text string").repartition(8)
    assert len(encode_documents(docs).collect()) == 40
    left = spark.range(8).repartition(8).mapInArrow(held, "n bigint").collect()
    assert [r["n"] for r in left] == [0] * len(left)
