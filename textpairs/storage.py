"""Intermediate tables that more than one pass reads."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


_STORED: dict[str, list[str]] = {}
_TABLES: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="textpairs-")
    sc.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Later passes that need two narrow columns then read two narrow columns, filters on
    ``partition_by`` columns skip whole folders, and a lost executor costs a re-read instead of a
    re-run of the whole lineage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    _STORED.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def materialise_bucketed(df: DataFrame, buckets: int, *by: str) -> DataFrame:
    """Write ``df`` once as a table whose files are dealt by the hash of ``by``: joins and groups on it need no shuffle."""
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(name)
    path = f"{shared_folder(spark).rstrip('/')}/{name}"
    _STORED.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.bucketBy(buckets, *by).option("path", path).saveAsTable(name)
    return spark.table(name)


def release(spark: SparkSession) -> None:
    """Delete the tables that this session has stored; frames that read them can no longer run."""
    sc = spark.sparkContext
    while _TABLES.get(sc.applicationId):
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES[sc.applicationId].pop()}")
    while _STORED.get(sc.applicationId):
        path = sc._jvm.org.apache.hadoop.fs.Path(_STORED[sc.applicationId].pop())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
