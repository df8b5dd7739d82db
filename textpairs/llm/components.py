"""Connected components of links that may be of any number and shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpairs.storage import materialise

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def _nearest(pairs: DataFrame) -> DataFrame:
    """``u, v, m`` with ``m`` the smallest of ``u`` and its partners ``v``; combined before the shuffle."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return pairs.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every end of ``links`` (``a, b``): the smallest node that links lead to.

    Alternates between tying all larger partners of a node to its smallest one and tying all smaller ones to it,
    until nothing changes; every round is a stored table. A node with very many links is an ordinary join key, which
    can be split, and never gathered into one row.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialise(edges)
    state = _state(edges)
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _nearest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        small = _nearest(large)
        tied = small.select(F.col("v").alias("u"), F.col("m").alias("v"))
        tied = tied.unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialise(tied)
        now = _state(edges)
        if now == state:
            roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        state = now
    raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
