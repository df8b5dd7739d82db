"""Fixed-size batches padded to their own maximum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textpairs.functions.sequences import pad_fixed, pad_to
from textpairs.operators.rank import with_position
from textpairs.schema import PAD_ID


def batch_and_pad(
    df: DataFrame,
    fields: dict[str, int] | None = None,
    size: int = 16,
    order: str | Sequence[str] = "index",
    max_len: int | None = None,
) -> DataFrame:
    """Consecutive rows in groups of ``size``; each array in ``fields`` (column to fill value) is padded
    to the longest of its batch, or to ``max_len``. The last batch may be short; no row is dropped.

    A frame that has a dense ``position`` column already is batched by it; otherwise the position in
    ``order`` is made first. A batch has ``size`` rows, so the padding exchange has no hot key; with
    ``max_len`` there is none.
    """
    fields = {"input_ids": PAD_ID} if fields is None else fields
    if "position" not in df.columns:
        df = with_position(df, order)
    out = df.withColumn("batch_id", F.expr(f"position div {int(size)}"))
    if max_len is not None:
        return out.withColumns({c: pad_fixed(c, max_len, fill) for c, fill in fields.items()})
    batch = W.partitionBy("batch_id")
    longest = {f"_max_{c}": F.max(F.size(c)).over(batch) for c in fields}
    padded = {c: pad_to(c, F.col(f"_max_{c}"), fill) for c, fill in fields.items()}
    return out.withColumns(longest).withColumns(padded).drop(*longest)
