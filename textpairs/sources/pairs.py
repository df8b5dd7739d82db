"""Pair tables from delimited or JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpairs.operators.rank import seeded_shuffle
from textpairs.operators.rows import with_sentinel_label
from textpairs.schema import PAIR_SCHEMA, check_columns

# Cells that count as missing, matched exactly.
MISSING = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "n/a",
    "nan",
    "null",
)


def _delimited(spark: SparkSession, path: str, sep: str, multi_line: bool, quoted: bool = True) -> DataFrame:
    """All cells as text, columns named by the header, missing tokens as null."""
    reader = (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("mode", "FAILFAST")
        .option("multiLine", multi_line)
        .option("enforceSchema", False)
        .option("escape", '"')
    )
    if not quoted:
        reader = reader.option("quote", "")
    df = reader.csv(path)
    return df.select(*[F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")).alias(c) for c in df.columns])


def _conform(df: DataFrame) -> DataFrame:
    check_columns(df, PAIR_SCHEMA, ignore_types=True)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PAIR_SCHEMA.fields])


def read_pairs(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Pair table from CSV with a header, in any column order.

    Quoted fields may hold newlines, which keeps one task per file. A corpus known to have none can be
    read with ``multi_line=False``, where large files are split; many files are read in parallel
    either way.
    """
    return _conform(_delimited(spark, path, ",", multi_line))


def read_unlabelled(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Pairs to be scored: whatever label the file holds is replaced by the sentinel."""
    return with_sentinel_label(read_pairs(spark, path, multi_line))


def read_external(
    spark: SparkSession,
    path: str,
    fmt: str = "tsv",
    mapping: dict[str, str | None] | None = None,
    multi_line: bool = False,
    quoted: bool | None = None,
) -> DataFrame:
    """Pairs of another corpus: ``mapping`` gives the source column of each pair column.

    ``fmt`` is ``tsv``, ``csv``, ``json`` (one object per line, or ``multi_line``) or ``parquet``.
    Tab-separated files are read without quoting unless ``quoted`` is set. A corpus without an index gets one from its
    rows: their place in the order of a hash of the row, equal rows side by side, whatever files they come from. JSON lines
    do not tell what they lack, so for them the index is mapped to None.
    """
    if fmt in ("tsv", "csv"):
        df = _delimited(spark, path, "\t" if fmt == "tsv" else ",", multi_line, (fmt == "csv") if quoted is None else quoted)
    elif fmt == "json":
        names = [(mapping or {}).get(f.name, f.name) for f in PAIR_SCHEMA.fields]
        schema = ", ".join(f"`{n}` string" for n in names if n is not None)
        df = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    elif fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt}")
    mapping = mapping or {}
    names = {f.name: mapping.get(f.name, f.name) for f in PAIR_SCHEMA.fields}
    numbered = names["index"] is None or "index" not in mapping and "index" not in df.columns
    if numbered:
        names.pop("index")
    missing = [n for n in names.values() if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    pairs = df.select(*[F.col(f"`{n}`").cast(PAIR_SCHEMA[c].dataType).alias(c) for c, n in names.items()])
    if numbered:
        whole = F.sha2(F.to_json(F.struct(*names)), 256)  # tells null from empty
        pairs = seeded_shuffle(pairs.withColumn("_row", whole), key="_row", position="index")
    return pairs.select(*PAIR_SCHEMA.names)
