"""Inputs in the shapes the operators expect, derived from the whole sample tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textpairs.functions.sequences import assemble_pair
from textpairs.functions.text import KNOWN_TYPOS
from textpairs.operators.attention import SpanAttention
from textpairs.operators.spans import span_blocks, spans_of
from textpairs.operators.vocab import encode_texts
from textpairs.schema import UNLABELLED
from textpairs.storage import materialise

LINES_PER_DOCUMENT = 1_000_000
TURNS_PER_CONVERSATION = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _null_if_empty(col: Column | str) -> Column:
    return F.nullif(F.col(col) if isinstance(col, str) else col, F.lit(""))


def _below(name: str, limit: int) -> Column:
    """The number itself; one that would run into the next key is an error."""
    too_large = F.raise_error(F.concat(F.lit(f"{name} does not fit below {limit}: "), F.col(name).cast("string")))
    return F.when(F.col(name) < limit, F.col(name)).otherwise(too_large.cast("int"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document line with the line after it: ``index, premise, hypothesis, label``.

    Empty lines are null; a document of one line has no hypothesis; documents without a quality label
    have no label.
    """
    labels = table(spark, sf_dir, "labels")
    name = (
        F.when(F.col("toxic") == 1, "contradiction")
        .when(F.col("quality") == 1, "entailment")
        .when(F.col("quality") == 0, "neutral")
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # The exchange the join on doc_id wants at scale; here it also spreads a file of one row group.
    labelled = docs.repartition("doc_id").join(labels.select("doc_id", name.alias("label")), "doc_id", "left")
    labelled = labelled.select("doc_id", "label", F.split("text", "\n", -1).alias("lines"))
    n = F.size("lines")
    exploded = labelled.select(
        "doc_id",
        "label",
        n.alias("n"),
        F.posexplode(F.arrays_zip(F.col("lines").alias("p"), F.slice("lines", F.lit(2), n).alias("h"))).alias("pos", "x"),
    ).where("pos < greatest(n - 1, 1)")
    return exploded.select(
        (F.col("doc_id") * LINES_PER_DOCUMENT + _below("pos", LINES_PER_DOCUMENT)).alias("index"),
        _null_if_empty("x.p").alias("premise"),
        _null_if_empty("x.h").alias("hypothesis"),
        "label",
    )


def dirty_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pairs`` with a kind of dirt put into the premise by (document + line) mod 8."""
    p = F.col("premise")
    kind = (F.floor(F.col("index") / LINES_PER_DOCUMENT) + F.col("index") % LINES_PER_DOCUMENT) % 8
    head, rest = F.substring(p, 1, 1), F.expr("substring(premise, 2)")
    typo = F.when(F.col("index") % 2 == 0, KNOWN_TYPOS[0][0]).otherwise(KNOWN_TYPOS[1][0])
    dirty = (
        F.when(kind == 0, F.concat(head, F.lit("\u00a0"), rest))
        .when(kind == 1, F.concat(head, F.lit("\u0008"), rest))
        .when(kind == 2, F.concat(F.lit("《"), p, F.lit("》")))
        .when(kind == 3, F.concat(F.lit("『"), p, F.lit("』")))
        .when(kind == 4, F.concat(head, F.lit("…"), rest))
        .when(kind == 5, F.concat(p, F.lit("．")))
        .when(kind == 6, F.replace(p, F.lit(" "), F.lit("\t\n\u3000\u2003\u001c")))
        .otherwise(F.concat(p, typo, p))
    )
    return pairs(spark, sf_dir).withColumn("premise", dirty)


def dialog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant turn right after it; turns are numbered without gaps.

    An equi-join on the unique (conversation, turn), so a conversation of any size is spread out.
    """
    turns = table(spark, sf_dir, "conversations")
    users = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("premise"))
    replies = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hypothesis")
    )
    key = ["conv_id", "turn"]
    return users.repartition(*key).join(replies, key).select(
        (F.col("conv_id") * TURNS_PER_CONVERSATION + _below("turn", TURNS_PER_CONVERSATION)).alias("index"),
        "premise",
        "hypothesis",
        F.lit(UNLABELLED).alias("label"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model per number of an embedding: it and the two after it, from the start again at the end, as logits.

    ``gold`` comes from the label.
    """
    vec, n = F.col("embedding").cast("array<double>"), F.size("embedding")
    triples = F.transform(vec, lambda x, m: F.array(x, F.get(vec, (m + 1) % n), F.get(vec, (m + 2) % n)))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        (F.col("label") % 3).cast("int").alias("gold"),
        F.posexplode(triples).alias("model_id", "logits"),
    ).select("model_id", "row_id", "logits", "gold")


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten embeddings in a row as the layers of one text."""
    return table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 10").alias("row_id"),
        (F.col("vec_id") % 10).cast("int").alias("layer"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("event_type").alias("metric"), "value"
    )


def span_attention(spark: SparkSession, sf_dir: str, vocab: DataFrame) -> SpanAttention:
    """All spans of the dialog pairs with a fixed score and a vector of four numbers."""
    ids = encode_texts(dialog(spark, sf_dir), {"premise": "p", "hypothesis": "h"}, vocab)
    sequences = ids.select(F.col("index").alias("row_id"), assemble_pair("p", "h", 512).alias("input_ids"))
    blocks = span_blocks(sequences.withColumn("length", F.size("input_ids")), ["row_id"])
    start, end = F.col("span_start"), F.col("span_end")
    score = ((F.col("row_id") * 7 + start * 3 + end * 5) % 11).cast("double") / 4.0

    def scored(some: DataFrame, keep: Sequence[str]) -> DataFrame:
        vec = F.array(start / 10.0, end / 10.0, (end - start).cast("double"), F.col("score"))
        return spans_of(some, keep).withColumn("score", score).withColumn("vec", vec)

    return SpanAttention(materialise(blocks), scored)
