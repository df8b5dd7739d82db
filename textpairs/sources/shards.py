"""Row-range shards of enriched text: ``<path>/hop=../shard=<start>-<stop>/``."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

SHARD_COLUMNS = ("hop", "shard", "row_index", "text", "status")
SHARD_SCHEMA = "row_index bigint, text string, status string, hop string, shard string"


def shard_name(start: int, stop: int) -> str:
    return f"{start}-{stop}"


def write_shard(df: DataFrame, path: str, hop: str, start: int, stop: int) -> None:
    """Write ``row_index, text, status`` of one range; writing the range again replaces it alone."""
    inside = (F.col("row_index") >= start) & (F.col("row_index") < stop)
    (
        df.where(inside)
        .select("row_index", "text", "status", F.lit(hop).alias("hop"), F.lit(shard_name(start, stop)).alias("shard"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("hop", "shard")
        .parquet(path)
    )


def read_shards(spark: SparkSession, path: str, hop: str | None = None) -> DataFrame:
    """All shards, or those of one hop, whose folder alone is listed; row order is the ``row_index`` column.

    A path without any shard gives an empty frame, so that a first run and a resumed one are alike.
    """
    # Other characters are escaped in folder names; such a hop is found by partition pruning.
    plain = hop is not None and re.fullmatch(r"[A-Za-z0-9_.-]+", hop)
    folder = f"{path.rstrip('/')}/hop={hop}" if plain else path
    try:
        df = spark.read.schema(SHARD_SCHEMA).option("basePath", path).parquet(folder).select(*SHARD_COLUMNS)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        df = spark.createDataFrame([], SHARD_SCHEMA).select(*SHARD_COLUMNS)
    return df if hop is None else df.where(F.col("hop") == hop)
