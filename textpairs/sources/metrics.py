"""Run metrics as an append-only table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_name(tag: str, fold: int) -> str:
    return f"{tag}_{fold}"


def run_group(plm: str, k_fold: int) -> str:
    return f"{plm}-k_fold" if k_fold > 0 else plm


def metric_rows(
    spark: SparkSession, values: dict[str, float], tag: str, fold: int, plm: str, k_fold: int, step: int
) -> DataFrame:
    """One row per metric of one evaluation: ``run, group, plm, fold, step, metric, value``."""
    rows = [(run_name(tag, fold), run_group(plm, k_fold), plm, fold, step, m, float(v)) for m, v in values.items()]
    return spark.createDataFrame(
        rows, "run string, group string, plm string, fold int, step bigint, metric string, value double"
    )


def append_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("run").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.withColumn("run", F.col("run").cast("string"))
