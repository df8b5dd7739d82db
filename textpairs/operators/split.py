"""Stratified folds and hold-outs; no row leaves its partition."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpairs.operators.rank import (
    BUCKET_BITS,
    as_key,
    attach_cuts,
    group_sizes,
    hash_histogram,
    not_after,
    rows_at,
    seeded_shuffle,
)


class Split(NamedTuple):
    train: DataFrame
    validation: DataFrame


def class_sizes(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).count()


def fold_sizes(sizes: dict[tuple, int], k: int) -> dict[tuple, list[int]]:
    """Rows per label and fold: labels in ascending order, the missing one first, are dealt to folds 0, 1, .., k-1, 0, ..
    without starting over, so each label and the folds as a whole differ by one row at most."""
    out, start = {}, 0
    for group in sorted(sizes, key=lambda g: [(v is not None, v) for v in g]):
        n = sizes[group]
        base, extra = divmod(n, k)
        out[group] = [base + (1 if (fold - start) % k < extra else 0) for fold in range(k)]
        start += n
    return out


def stratified_kfold(
    df: DataFrame,
    k: int = 5,
    label: str = "label",
    key: str | Sequence[str] = "index",
    seed: int = 42,
    fold: str = "fold",
    bits: int = BUCKET_BITS,
) -> DataFrame:
    """Add ``fold`` in 0..k-1: within a label, rows in hash order are cut into ``k`` near-equal runs.

    The cuts are found on call from (label, key) alone; the returned plan adds a map-side join with
    one row per label.
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    key = as_key(key)
    with hash_histogram(df, [label], key, seed, bits) as histogram:
        sizes = group_sizes(histogram, [label])
        if sizes and max(sizes.values()) < k:
            raise ValueError(f"every label has fewer than {k} rows")
        ends = {group: list(accumulate(counts))[:-1] for group, counts in fold_sizes(sizes, k).items()}
        cuts = rows_at(df, histogram, ends, [label], key, seed, bits)
    out = attach_cuts(df, cuts, [label], key, seed)
    before = [F.when(not_after(j, key), 0).otherwise(1) for j in range(cuts.width)]
    number = before[0] if before else F.lit(0)
    for b in before[1:]:
        number = number + b
    return out.select(*df.columns, number.cast("int").alias(fold))


def fold_pairs(df: DataFrame, k: int, fold: str = "fold") -> list[Split]:
    """The ``k`` (train, validation) views of a frame that carries its fold; filters, not copies."""
    return [Split(df.where(F.col(fold) != i), df.where(F.col(fold) == i)) for i in range(k)]


def fold_pairs_long(df: DataFrame, k: int, fold: str = "fold") -> DataFrame:
    """All ``k`` views in one frame: each row once per ``run``, marked by ``part``."""
    return df.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn(
        "part", F.when(F.col("run") == F.col(fold), "validation").otherwise("train")
    )


def holdout_assign(
    df: DataFrame,
    ratio: float,
    label: str = "label",
    key: str | Sequence[str] = "index",
    seed: int = 42,
    part: str = "part",
    bits: int = BUCKET_BITS,
) -> DataFrame:
    """Add ``part``: per label, exactly ``int(n * ratio)`` rows drawn by hash are ``validation``."""
    key = as_key(key)
    with hash_histogram(df, [label], key, seed, bits) as histogram:
        wanted = {g: [int(n * ratio)] for g, n in group_sizes(histogram, [label]).items()}
        cuts = rows_at(df, histogram, wanted, [label], key, seed, bits)
    out = attach_cuts(df, cuts, [label], key, seed)
    chosen = not_after(0, key) if cuts.width else F.lit(False)
    return out.select(*df.columns, F.when(chosen, "validation").otherwise("train").alias(part))


def stratified_holdout(
    df: DataFrame, ratio: float, label: str = "label", key: str | Sequence[str] = "index", seed: int = 42
) -> Split:
    assigned = holdout_assign(df, ratio, label, key, seed, "_part")
    return Split(
        assigned.where("_part = 'train'").drop("_part"), assigned.where("_part = 'validation'").drop("_part")
    )


def shuffle_parts(split: Split, seed: int = 42, key: str | Sequence[str] = "index") -> Split:
    """Independent permutations of both parts, as a ``position`` column."""
    return Split(seeded_shuffle(split.train, seed, key), seeded_shuffle(split.validation, seed + 1, key))


def split(
    df: DataFrame,
    k_fold: int = 0,
    val_ratio: float = 0.0,
    train: bool = True,
    key: str | Sequence[str] = "index",
    seed: int = 42,
) -> list[Split] | DataFrame:
    """Folds if asked for in training, else a hold-out if a ratio is given, else the whole frame:
    as it is for scoring, with an empty validation part for training."""
    if k_fold > 0 and train:
        return fold_pairs(stratified_kfold(df, k_fold, key=key, seed=seed), k_fold)
    if val_ratio > 0:
        return [stratified_holdout(df, val_ratio, key=key, seed=seed)]
    if not train:
        return df
    return [Split(df, df.limit(0))]
