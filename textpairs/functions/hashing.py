"""Deterministic draws that do not depend on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_BITS = 32


def hex_number(digest: Column, start: int, digits: int = 8) -> Column:
    """``digits`` hex digits of a digest from 1-based ``start``, as bigint."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("bigint")


def draw(seed: int, key: Sequence[str]) -> Column:
    """Uniform integer in [0, 2**32) from the seed and the row key."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])
    return hex_number(F.md5(text), 1)
