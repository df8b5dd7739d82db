"""Class-balanced and form-matched samples, and corpus mixing."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpairs.operators.rank import (
    BUCKET_BITS,
    as_key,
    attach_cuts,
    group_sizes,
    hash_histogram,
    not_after,
    rows_at,
)

LENGTH_STEP = 20
LENGTH_BINS = 11  # steps of 20 characters, the last one open at 200


def _take(
    df: DataFrame,
    quota: Callable[[tuple, int], int],
    group: Sequence[str],
    key: Sequence[str],
    seed: int,
    bits: int,
) -> DataFrame:
    """The first ``quota(group, size)`` rows of each group in hash order, by comparison with the last of them."""
    with hash_histogram(df, group, key, seed, bits) as histogram:
        wanted = {g: [min(size, quota(g, size))] for g, size in group_sizes(histogram, group).items()}
        cuts = rows_at(df, histogram, wanted, group, key, seed, bits)
    if not cuts.width:
        return df.limit(0)
    return attach_cuts(df, cuts, group, key, seed).where(not_after(0, key)).select(*df.columns)


def balanced_sample(
    df: DataFrame,
    n: int,
    seed: int = 42,
    label: str = "label",
    key: str | Sequence[str] = "index",
    bits: int = BUCKET_BITS,
) -> DataFrame:
    """``n`` rows of each label, or the whole label if it is smaller."""
    return _take(df, lambda g, size: n, [label], as_key(key), seed, bits)


def length_bin(col: Column | str) -> Column:
    return F.least(F.floor(F.char_length(col) / LENGTH_STEP), F.lit(LENGTH_BINS - 1)).cast("int")


def form_quotas(counts: dict[tuple, int], n: int) -> dict[tuple, int]:
    """Split ``n`` in the proportions of ``counts``: floors, then one each to the largest remainders
    (ties to the lower bin)."""
    total = sum(counts.values())
    if not total:
        return {}
    quota = {b: n * c // total for b, c in counts.items()}
    rest = sorted(counts, key=lambda b: (-(n * counts[b] % total), b))
    for b in rest[: n - sum(quota.values())]:
        quota[b] += 1
    return quota


def sample_like(
    df: DataFrame,
    target: DataFrame,
    n: int,
    seed: int = 42,
    label: str = "label",
    key: str | Sequence[str] = "index",
    bits: int = BUCKET_BITS,
) -> DataFrame:
    """``n`` rows per label whose joint premise/hypothesis length bins follow the target's shares.

    A bin with too few rows gives what it has. At most 121 bins per label are counted and compared.
    """
    bins = {"_premise_bin": length_bin("premise"), "_hypothesis_bin": length_bin("hypothesis")}
    group = [label, *bins]
    counts = target.select(*[e.alias(c) for c, e in bins.items()]).groupBy(*bins).count().collect()
    quotas = form_quotas({(r["_premise_bin"], r["_hypothesis_bin"]): r["count"] for r in counts}, n)
    taken = _take(df.withColumns(bins), lambda g, size: quotas.get(g[1:], 0), group, as_key(key), seed, bits)
    return taken.select(*df.columns)


def mix(**parts: DataFrame) -> DataFrame:
    """All parts under each other with their ``source`` name; ``(source, index)`` is the new key."""
    cols = ("index", "premise", "hypothesis", "label")
    named = [df.select(F.lit(name).alias("source"), *cols) for name, df in parts.items()]
    return reduce(DataFrame.unionByName, named)
