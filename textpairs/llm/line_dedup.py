"""Line de-duplication against levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textpairs.llm.common import SPACES, col, digest, fold_ascii, partitions
from textpairs.storage import materialise, shared_folder

MIN_CHARS = 10
FAN_IN = 2
BATCHES = 4


def line_key(line: Column) -> Column:
    return fold_ascii(F.btrim(line, F.lit(SPACES)))


class LineRuns:
    """Which document holds a line first, kept as sorted runs of line hashes in levels.

    Every batch adds a run of the keys no older run holds, so a key is in one run only. When a level has
    ``fan_in`` runs they are merged into one run of the next level, so a batch meets a number of runs that grows
    with the logarithm of the batches. Runs are bucketed by hash and sorted in each bucket: a merge with a batch
    shuffles the batch once and the runs never. They lie in the shared folder, and a lost executor re-reads them.
    """

    def __init__(self, spark: SparkSession, fan_in: int = FAN_IN, buckets: int | None = None):
        self.spark, self.fan_in, self.buckets = spark, fan_in, buckets or partitions(spark)
        self.levels: list[list[str]] = []

    def _write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        path = f"{shared_folder(self.spark).rstrip('/')}/{name}"
        dealt = run.repartition(self.buckets, "h1", "h2")
        dealt.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, keys: DataFrame) -> DataFrame:
        """Merge a batch of ``h1, h2, first, last`` with the runs and add the keys that none of them holds.

        ``first`` and ``last`` are the smallest and largest document id of a key in the batch, one row per key.
        Batches come in document order, so a key's holder in an older run precedes the whole batch. Returns
        ``h1, h2, holder`` of the batch's keys that a document other than the holder has.
        """
        merged = keys.withColumn("holder", F.lit(None).cast(keys.schema["first"].dataType))
        for run in self.runs():
            found = run.withColumnRenamed("first", "found")
            merged = merged.join(found, ["h1", "h2"], "left").withColumn("holder", F.coalesce("holder", "found")).drop("found")
        merged = materialise(merged)
        self._push(0, self._write(merged.where("holder is null").select("h1", "h2", "first")))
        met = merged.select("h1", "h2", F.coalesce("holder", "first").alias("holder"), "last")
        return met.where("last != holder").select("h1", "h2", "holder")

    def _push(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fan_in:
            old, self.levels[level] = self.levels[level], []
            self._push(level + 1, self._write(reduce(DataFrame.unionByName, [self.spark.table(n) for n in old])))


def drop_repeated_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    batches: int = BATCHES,
    fan_in: int = FAN_IN,
    min_chars: int = MIN_CHARS,
    carry: Sequence[str] = (),
) -> DataFrame:
    r"""Every document without the lines that a document with a smaller id holds.

    A line's key is the line stripped of ``[\x20\x09-\x0D]`` at both ends with A-Z lower-cased. Keys of at least
    ``min_chars`` code points that two or more documents hold lose all lines except those of the smallest id; other
    lines stay, joined by newlines. Returns ``doc_id, n_lines, n_dropped, text`` (text after dropping), and the columns to
    carry as ``carried_<name>``. Documents enter in ``batches`` runs of ids; the result does not depend on their number.

    Null or empty text is one empty line. A row without id holds no line and loses none. Rows that repeat an id
    count as one document. A line repeated inside its first document stays. An empty table gives no rows; other
    columns are left out.
    """
    spark = docs.sparkSession
    body = F.coalesce(col(text), F.lit(""))
    carried = [f"carried_{c}" for c in carry]
    rows = docs.select(col(key).alias("doc_id"), body.alias("text"), *[col(c).alias(f"carried_{c}") for c in carry])
    lines = (
        rows.where("doc_id is not null")
        .select("doc_id", F.xxhash64("text").alias("body"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select("doc_id", "body", "pos", line_key(F.col("line")).alias("k"))
        .where(F.length("k") >= min_chars)
        .select("doc_id", "body", "pos", *digest("k"))
    )
    stored = materialise(lines)
    shares = [i / batches for i in range(1, batches)]
    cuts = rows.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)))).first()[0] if shares else []
    cuts = sorted(set(cuts or []))
    runs = LineRuns(spark, fan_in)
    met = []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = stored
        if low is not None:
            part = part.where(F.col("doc_id") > F.lit(low))
        if high is not None:
            part = part.where(F.col("doc_id") <= F.lit(high))
        met.append(runs.add(part.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))))
    repeated = materialise(reduce(DataFrame.unionByName, met).distinct())
    drops = (
        stored.join(repeated, ["h1", "h2"])
        .where(F.col("doc_id") != F.col("holder"))
        .groupBy("doc_id", "body")
        .agg(F.collect_set("pos").alias("drops"))
    )
    split = F.split("text", "\n", -1)
    joined = rows.withColumn("body", F.xxhash64("text")).join(drops, ["doc_id", "body"], "left")
    joined = joined.withColumn("lines", split).withColumn("n_lines", F.size("lines").cast("bigint"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops"))
    kept_text = F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")
    return joined.select(
        "doc_id",
        "n_lines",
        F.coalesce(F.size("drops"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(F.col("drops").isNull(), F.col("text")).otherwise(kept_text).alias("text"),
        *carried,
    )
