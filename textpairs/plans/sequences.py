"""Encoded pair sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpairs.functions.sequences import assemble_pair, attention_mask, segment_ids, truncate_longest_first
from textpairs.operators.batches import batch_and_pad
from textpairs.operators.vocab import encode_texts
from textpairs.storage import materialise


def encoded_pairs(df: DataFrame, vocab: DataFrame, max_length: int | None = 512) -> DataFrame:
    """Add ``premise_ids, hypothesis_ids, input_ids, length``."""
    ids = encode_texts(df, {"premise": "premise_ids", "hypothesis": "hypothesis_ids"}, vocab)
    return ids.withColumn("input_ids", assemble_pair("premise_ids", "hypothesis_ids", max_length)).withColumn(
        "length", F.size("input_ids")
    )


def encoded_items(df: DataFrame, vocab: DataFrame, max_length: int = 256, size: int = 16, order: str = "index") -> DataFrame:
    """Batches of ``input_ids``, ``attention_mask`` and ``token_type_ids`` of equal length.

    The longer side is cut first; arrays are padded to the longest of their batch. The ids are stored before they
    are put in order, so texts are encoded once.
    """
    pairs = encoded_pairs(df, vocab, None)
    ids = assemble_pair(*truncate_longest_first("premise_ids", "hypothesis_ids", max_length))
    rest = [c for c in df.columns if c not in ("premise", "hypothesis")]
    stored = materialise(pairs.select(*rest, ids.alias("input_ids")))
    return batch_and_pad(stored, size=size, order=order).withColumns(
        {"attention_mask": attention_mask("input_ids"), "token_type_ids": segment_ids("input_ids")}
    )
