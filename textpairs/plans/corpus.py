"""Masked-token corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpairs.functions.labels import encode_label
from textpairs.functions.masking import mlm_mask
from textpairs.functions.text import PAIR_SEPARATOR, clean_text, join_pair_text
from textpairs.operators.dedup import dedup_keep_first
from textpairs.operators.rows import clean_pairs
from textpairs.operators.vocab import encode_texts
from textpairs.schema import SEP_ID, START_ID


def mlm_corpus(df: DataFrame, clean_first: bool = False) -> DataFrame:
    """``index, sentence, label``: joined pairs, first of each kept, then cleaned.

    Duplicates are judged on the raw joined text, so rows that become equal by cleaning both stay, and a
    known-typo match replaces the joined text as a whole. ``clean_first`` cleans each side before joining.
    """
    if clean_first:
        df = clean_pairs(df)
    joined = df.select(
        "index",
        join_pair_text("premise", "hypothesis").alias("sentence"),
        encode_label("label", null_is_error=True).alias("label"),
    )
    unique = dedup_keep_first(joined, "sentence")
    return unique if clean_first else unique.withColumn("sentence", clean_text("sentence"))


def masked_corpus(
    df: DataFrame, vocab: DataFrame, vocab_size: int | None = None, p: float = 0.15, seed: int = 42
) -> DataFrame:
    """``index, input_ids, masked_ids, labels`` of an MLM corpus: start, both texts with the separator between, separator.

    Random ids are drawn from the ``vocab_size`` words of the vocabulary, counted if not given.
    """
    vocab_size = vocab.count() if vocab_size is None else vocab_size
    spaced = df.select("index", F.replace("sentence", F.lit(PAIR_SEPARATOR), F.lit(f" {PAIR_SEPARATOR} ")).alias("sentence"))
    encoded = encode_texts(spaced, {"sentence": "_ids"}, vocab, specials={PAIR_SEPARATOR: SEP_ID})
    outer = [F.array(F.lit(i).cast("int")) for i in (START_ID, SEP_ID)]
    encoded = encoded.withColumn("input_ids", F.concat(outer[0], "_ids", outer[1]))
    masked = encoded.withColumn("_masked", mlm_mask("input_ids", ["index"], vocab_size, p, seed))
    return masked.select(
        "index",
        "input_ids",
        F.col("_masked.masked_id").alias("masked_ids"),
        F.col("_masked.label").alias("labels"),
        F.size("input_ids").alias("length"),
    )
