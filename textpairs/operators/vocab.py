"""Word vocabulary and text encoding."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textpairs.functions.text import words
from textpairs.operators.rank import with_position
from textpairs.schema import FIRST_TOKEN_ID, UNKNOWN_ID
from textpairs.storage import materialise, materialise_bucketed

MAX_VOCABULARY = 2_000_000
BLOCK_BITS = 12
MIX = 0x9E3779B97F4A7C15
_INDEXES: dict[str, WordIndex] = {}


def _hashes(texts: pa.Array) -> np.ndarray:
    """A 64-bit hash of the bytes of each string."""
    wide = texts.cast(pa.large_string())
    _, offsets, data = wide.buffers()
    ends = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    lengths = np.diff(ends)
    place = np.arange(ends[-1] - ends[0]) - np.repeat(ends[:-1] - ends[0], lengths)
    powers = np.cumprod(np.full(lengths.max(initial=0), MIX, np.uint64))
    values = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]].astype(np.uint64) + np.uint64(1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values * powers[place])])
    total = (sums[ends[1:] - ends[0]] - sums[ends[:-1] - ends[0]]) ^ lengths.astype(np.uint64)
    return (total ^ (total >> np.uint64(29))) * np.uint64(MIX)


class WordIndex:
    """Ids of words in plain arrays, sorted by a hash; a few bytes a word beside the words themselves.

    A word is known where the one at its hash is the same. Words that share a hash, among them repeated ones, of which the
    last counts, and ``specials``, which go before all others, are in a dictionary.
    """

    def __init__(self, words_: pa.Array, ids: pa.Array, unknown: int, specials: dict[str, int] | None = None):
        known = pc.is_valid(words_)
        if specials:
            known = pc.and_(known, pc.invert(pc.is_in(words_, pa.array(list(specials), words_.type))))
        words_, ids = words_.filter(known), pc.fill_null(ids.filter(known).cast(pa.int32()), unknown)
        hashes = _hashes(words_)
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        same, equal = np.zeros(len(hashes), bool), hashes[1:] == hashes[:-1]
        same[1:] |= equal
        same[:-1] |= equal
        shared = np.sort(order[same])
        self.rest = dict(zip(words_.take(shared).to_pylist(), ids.take(shared).to_pylist(), strict=True)) | (specials or {})
        self.hashes, self.words = hashes[~same], words_.take(order[~same])
        self.ids, self.unknown = ids.take(order[~same]).to_numpy(), unknown

    def look_up(self, asked: pa.Array) -> pa.Array:
        """Ids of distinct words."""
        ids = np.full(len(asked), self.unknown, np.int32)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashed := _hashes(asked)), len(self.hashes) - 1)
            met = np.flatnonzero(self.hashes[at] == hashed)
            at = at[met]
            same = pc.equal(self.words.take(at), asked.take(met).cast(self.words.type)).to_numpy(zero_copy_only=False)
            ids[met[same]] = self.ids[at[same]]
            left = np.setdiff1d(np.arange(len(asked)), met[same], assume_unique=True) if self.rest else ()
        else:
            left = np.arange(len(asked))
        if self.rest and len(left):
            ids[left] = [self.rest.get(word, self.unknown) for word in asked.take(left).to_pylist()]
        return pa.array(ids)


def _index(name: str, shared: Broadcast) -> WordIndex:
    """Read once in each Python worker, which serves one vocabulary at a time."""
    if name not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[name] = shared.value
    return _INDEXES[name]


def build_vocab(
    df: DataFrame, cols: Sequence[str] = ("premise", "hypothesis"), size: int | None = 32_000
) -> DataFrame:
    """The ``size`` most frequent words, or all, with ids from 5: ``token, token_count, token_id``.

    Words are counted before the shuffle, so the commonest word is no hot spot. How many words share a count
    is a small table, one row per count; its running sum tells the smallest count that is still taken, so only
    words at or above it go on. These are dealt into ordered pieces of count and word, so that the words of one count, of
    which most occur once or twice, are ranked in as many tasks as there are pieces.
    """
    # Nulls are skipped by explode; each column is split on its own, so no word spans two texts.
    every = F.concat(*[F.coalesce(words(c), F.array().cast("array<string>")) for c in cols])
    counted = materialise(df.select(F.explode(every).alias("token")).groupBy("token").agg(F.count("*").alias("token_count")))
    if size is not None:
        before = W.orderBy(F.desc("token_count")).rowsBetween(W.unboundedPreceding, -1)
        levels = counted.groupBy("token_count").agg(F.count("*").alias("_n"))
        levels = levels.select("token_count", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        least = levels.where(F.col("_before") < size).agg(F.min("token_count")).first()[0]
        counted = counted.where(F.col("token_count") >= F.lit(least))
    ranked = with_position(counted, [F.desc("token_count"), F.col("token")], "_position")
    if size is not None:
        ranked = ranked.where(F.col("_position") < size)
    return ranked.select("token", "token_count", (F.col("_position") + FIRST_TOKEN_ID).cast("int").alias("token_id"))


def encode_texts(
    df: DataFrame,
    cols: dict[str, str],
    vocab: DataFrame,
    unknown: int = UNKNOWN_ID,
    specials: dict[str, int] | None = None,
) -> DataFrame:
    """Add an id array per text column: ``cols`` maps a text column to its output column.

    A vocabulary of at most ``MAX_VOCABULARY`` words is sent to each worker once, as sorted arrays, and looked up for the
    distinct words of a batch, so rows stay where they are: no exploded words, no exchange, no regrouping. A larger one
    stays dealt out, and the distinct words of blocks of rows go to it. ``specials`` are words with ids of their own.
    """
    if vocab.limit(MAX_VOCABULARY + 1).count() > MAX_VOCABULARY:
        return _encode_blocks(df, cols, vocab, unknown, dict(specials or {}))
    entries = vocab.select("token", F.col("token_id").cast("int")).toArrow()
    whole = [entries[c].combine_chunks() for c in ("token", "token_id")]
    shared = df.sparkSession.sparkContext.broadcast(WordIndex(*whole, unknown, specials))
    name = uuid.uuid4().hex

    def look_up(batch: pa.Array) -> pa.Array:
        return _looked_up(batch, _index(name, shared))

    # Marked so that a later filter on the ids is not pushed below and the lookup run once for each.
    encode = F.arrow_udf(look_up, T.ArrayType(T.IntegerType())).asNondeterministic()
    return reduce(lambda out, c: out.withColumn(c[1], encode(words(c[0]))), cols.items(), df)


def _looked_up(batch: pa.Array, index: WordIndex) -> pa.Array:
    """Id arrays of an array of word arrays; each distinct word is looked up once."""
    offsets = pa.array(pc.add(pc.subtract(batch.offsets, batch.offsets[0]), 0), pa.int32())
    words_ = batch.flatten().dictionary_encode()
    filled = pc.fill_null(pc.take(index.look_up(words_.dictionary), words_.indices), index.unknown)
    mask = batch.is_null() if batch.null_count else None
    return pa.ListArray.from_arrays(offsets, filled, mask=mask)


def _encode_blocks(
    df: DataFrame, cols: dict[str, str], vocab: DataFrame, unknown: int, specials: dict[str, int]
) -> DataFrame:
    """Blocks of neighbouring rows ask a dealt-out vocabulary for their distinct words.

    Rows are stored once, dealt by their block, and do not move again; what is shuffled is a block's distinct words and
    the small dictionary that comes back. A frequent word is asked for once per block, and the runtime may split its rows.
    """
    spark = df.sparkSession
    split = {f"_words{i}": words(c) for i, c in enumerate(cols)}
    block = F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = materialise_bucketed(df.withColumns(split).withColumn("_block", block), buckets, "_block")
    every = F.concat(*[F.coalesce(w, F.array().cast("array<string>")) for w in split])
    asked = rows.select(F.col("_block").alias("_of"), F.explode(F.array_distinct(every)).alias("token")).distinct()
    known = asked.join(vocab.select("token", F.col("token_id").cast("int").alias("token_id")), "token")
    kept, columns = df.columns, list(zip(cols.values(), split, strict=True))

    def encode(some: pa.Table, dictionary: pa.Table) -> pa.Table:
        index = WordIndex(dictionary["token"].combine_chunks(), dictionary["token_id"].combine_chunks(), unknown, specials)
        out = some.select(kept)
        for name, column in columns:
            out = out.append_column(name, _looked_up(some[column].combine_chunks(), index))
        return out

    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in cols.values()]])
    return rows.groupBy("_block").cogroup(known.groupBy("_of")).applyInArrow(encode, schema)
