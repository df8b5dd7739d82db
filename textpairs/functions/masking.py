"""Masked-token training examples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from textpairs.functions.hashing import hex_number
from textpairs.schema import FIRST_TOKEN_ID, MASK_ID, SEP_ID

NOT_SELECTED = -100


def mlm_mask(
    ids: Column | str, key: Sequence[str], vocab_size: int, p: float = 0.15, seed: int = 42
) -> Column:
    """Array of ``(masked_id, label)`` per token: a share ``p`` of the tokens is drawn; of those 80 %
    become the mask id, 10 % a random id, 10 % stay. The label is the original id where drawn and -100
    elsewhere. Select ``col.masked_id`` and ``col.label`` from it in a step of its own, so that the draws are
    made once.

    Draws come from ``md5(seed:key:position)``, so a row gives the same result anywhere; another
    epoch is another seed. Start, pad and separator are never drawn.
    """
    if not 0 <= p < 1:
        raise ValueError("p must be in [0, 1)")
    ids = F.col(ids) if isinstance(ids, str) else ids
    prefix = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])
    digests = F.transform(ids, lambda _, i: F.md5(F.concat(prefix, F.lit(":"), i.cast("string"))))
    limit = f"{int(p * 2**32):08x}"  # hex digits of equal number compare like the numbers they spell

    def selected(x: Column, digest: Column) -> Column:
        return (x > SEP_ID) & (F.substring(digest, 1, 8) < limit)

    def outcome(x: Column, digest: Column) -> Column:
        drawn = selected(x, digest)
        kind = hex_number(digest, 9) % 10
        random_id = (F.lit(FIRST_TOKEN_ID) + hex_number(digest, 17) % vocab_size).cast("int")
        changed = F.when(kind < 8, F.lit(MASK_ID)).when(kind == 8, random_id).otherwise(x)
        return F.struct(
            F.when(drawn, changed).otherwise(x).alias("masked_id"),
            F.when(drawn, x).otherwise(F.lit(NOT_SELECTED)).alias("label"),
        )

    return F.zip_with(ids, digests, outcome)
