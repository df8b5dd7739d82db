"""Row-local preparation on a stream of pair files.

There is no operator of its own here: ``prepared_pairs`` and every expression in ``functions`` take
streaming frames as they are. Folds and samples need counts of the whole table and stay batch jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textpairs.plans.training import prepared_pairs
from textpairs.schema import PAIR_SCHEMA


def stream_prepared_pairs(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Pairs appended to a folder, prepared as they arrive."""
    return prepared_pairs(spark.readStream.schema(PAIR_SCHEMA).format(fmt).load(path))
