"""A training corpus from raw documents: each stage is written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpairs.llm.byte_bpe import encode_documents
from textpairs.llm.common import digest, table
from textpairs.llm.decontaminate import find_passages
from textpairs.llm.jaccard_join import jaccard_classes
from textpairs.llm.line_dedup import drop_repeated_lines
from textpairs.llm.quality import fit_cutoffs, measure_documents, verdict
from textpairs.storage import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified cutoffs of their language."""
    cutoffs = materialise(fit_cutoffs(materialise(measure_documents(docs)), table(spark, sf_dir, "labels")))
    rest = [c for c in COLUMNS if c != "doc_id"]
    passed = verdict(measure_documents(docs, carry=rest), cutoffs).where("kept")
    return passed.select("doc_id", *[F.col(f"carried_{c}").alias(c) for c in rest])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that one with a smaller id holds."""
    kept = drop_repeated_lines(docs, carry=["lang", "source"])
    return kept.select(
        "doc_id",
        "text",
        F.col("carried_lang").alias("lang"),
        F.col("carried_source").alias("source"),
        F.char_length("text").cast("bigint").alias("n_chars"),
    )


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, the one with the smallest id; texts without words stay.

    The class of a row follows from its text alone, so classes are named by hashes of texts and rows are told apart by id
    and hash: of equal ids the text with the smallest hash stays, a row without id only where no other has one, and one
    of the rows with the same id and text.
    """
    rows = docs.select(*COLUMNS, *digest("text"))
    many = _repeated_texts(rows)
    texts = jaccard_classes(_one_of_each_text(rows, many), key="h1").where("n_shingles > 0")
    texts = materialise(texts.select(F.col("doc_id").alias("h1"), "component_id").distinct())
    copies = F.sum(F.coalesce("n", F.lit(1)))
    copied = texts.join(many, "h1", "left").groupBy("component_id").agg(copies.alias("n")).where("n > 1").select("component_id")
    texts = materialise(texts.join(copied, "component_id").select("h1", "component_id"))
    named = rows.select("doc_id", "h1", "h2").join(texts, "h1")
    named = materialise(named.groupBy("component_id", "doc_id", "h1", "h2").agg(F.count("*").alias("n")))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h1", "h2")
    first = named.groupBy("component_id").agg(F.min(place).alias("first"))
    judged = named.join(first, "component_id").withColumn("stays", place.eqNullSafe(F.col("first")))
    judged = materialise(judged.where("n > 1 or not stays").select("doc_id", "h1", "h2", "stays"))
    kept = _rows_of(rows, judged, "left_anti").select(*COLUMNS)
    repeated = judged.where("stays")
    if repeated.isEmpty():
        return kept
    rest = F.struct(*[c for c in COLUMNS if c not in ("doc_id", "text")], "text")
    one = _rows_of(rows, repeated, "left_semi").groupBy("doc_id", "h1", "h2").agg(F.min(rest).alias("chosen"))
    return kept.unionByName(one.select("doc_id", "chosen.*").select(*COLUMNS))


def _repeated_texts(rows: DataFrame) -> DataFrame:
    """``h1, n, least``: the texts with words that several rows hold, how many, and the smallest id."""
    texts = rows.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return materialise(texts.groupBy("h1").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).where("n > 1"))


def _one_of_each_text(rows: DataFrame, many: DataFrame) -> DataFrame:
    """``h1, text``, texts without words left out; of the rows with one text those with the smallest id alone."""
    texts = rows.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    met = texts.join(many.select(F.col("h1").alias("many"), "least"), F.expr("h1 = many"), "left")
    return met.where(F.col("many").isNull() | F.col("doc_id").eqNullSafe(F.col("least"))).select("h1", "text")


def _rows_of(rows: DataFrame, some: DataFrame, how: str) -> DataFrame:
    """Join on id, null like any other, and hash of the text."""
    r, s = rows.alias("r"), some.alias("s")
    return r.join(s, F.expr("r.doc_id <=> s.doc_id and r.h1 = s.h1 and r.h2 = s.h2"), how)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text shares no passage with a benchmark item, whatever their ids."""
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("body"))
    passages = find_passages(rows, table(spark, sf_dir, "benchmark"), key="body")
    leaks = materialise(passages.select(F.col("doc_id").alias("body")).distinct())
    return rows.join(leaks, "body", "left_anti").select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the hash of the bytes that they decode to."""
    rows = encode_documents(docs)
    return rows.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

# Certified cutoffs, near-duplicate classes and token ids are checked against brute force in the tests.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; ids may be missing or repeated, each row is judged by its own text."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
