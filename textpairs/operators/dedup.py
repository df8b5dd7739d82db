"""Exact duplicate removal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textpairs.functions.text import join_pair_text


def dedup_keep_first(
    df: DataFrame, key: Column | str | None = None, order: str | Sequence[str] = "index"
) -> DataFrame:
    """Keep the row that comes first in ``order`` among rows of equal ``key`` text (default: the joined pair).

    Spark cuts each map task down to one row per key before the exchange, so a text that makes up a
    third of the corpus reaches its reducer once per map task. Texts are told apart by their SHA-256
    digest: 32 bytes are sorted and shuffled beside the row instead of a second copy of its text. A row without a key is
    like no other and stays.
    """
    if key is None:
        key = join_pair_text("premise", "hypothesis")
    order = [order] if isinstance(order, str) else list(order)
    text = F.col(key) if isinstance(key, str) else key
    # A byte longer than a digest of text, so the two kinds never meet.
    own = F.concat(F.unhex(F.sha2(F.concat_ws("\x00", *[F.col(c).cast("string") for c in order]), 256)), F.lit(b"\x00"))
    first = W.partitionBy("_digest").orderBy(*order)
    return (
        df.withColumn("_digest", F.coalesce(F.unhex(F.sha2(text, 256)), own))
        .withColumn("_rank", F.row_number().over(first))
        .where("_rank = 1")
        .drop("_digest", "_rank")
    )
