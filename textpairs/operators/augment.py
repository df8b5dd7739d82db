"""Text enrichment by an outside function, in resumable row ranges."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textpairs.functions.text import clean_text, is_empty_result
from textpairs.operators.rows import pending_rows
from textpairs.sources.shards import read_shards
from textpairs.storage import materialise

Translate = Callable[[list[str]], list[str]]

CALL_ROWS = 99  # fixed value: texts per call
MAX_SHARDS = 100_000


def _call(fn: Translate, texts: list[str]) -> list[tuple[str, bool]]:
    """``(result, raised)`` per text. If the call as a whole fails, each text is tried alone."""
    try:
        out = list(fn(texts))
        if len(out) != len(texts):
            raise ValueError(f"{len(out)} results for {len(texts)} texts")
        return [("" if t is None else str(t), False) for t in out]
    except Exception:  # noqa: BLE001  a user function may raise anything; the row carries the outcome
        if len(texts) == 1:
            return [("", True)]
        return [_call(fn, [t])[0] for t in texts]


def _enrich(fn: Translate, texts: list[str | None], retry: int) -> list[tuple[str, str]]:
    """``(text, status)`` per input: ``ok``, ``empty`` after ``retry`` more calls, or ``failed``."""
    given = [i for i, t in enumerate(texts) if t is not None]
    state: list[tuple[str, bool]] = [("", True)] * len(texts)
    for i, result in zip(given, _call(fn, [texts[i] for i in given]) if given else []):
        state[i] = result
    for _ in range(retry):
        again = [i for i in given if not state[i][1] and state[i][0] in ("", " ")]
        if not again:
            break
        for i, result in zip(again, _call(fn, [texts[i] for i in again])):
            state[i] = result
    return [(t, "failed" if raised else "empty" if t in ("", " ") else "ok") for t, raised in state]


def enrich_column(df: DataFrame, col: str, fn: Translate, retry: int = 1, index: str = "index") -> DataFrame:
    """``row_index, text, status``: the result of ``fn`` for every row, in calls of at most 99 texts.

    Only the index and the text cross to Python. ``fn`` may be called again for the same text when a
    task is retried.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [t if isinstance(t, str) else None for t in frame["text"]]
            done = [r for at in range(0, len(texts), CALL_ROWS) for r in _enrich(fn, texts[at : at + CALL_ROWS], retry)]
            yield pd.DataFrame(
                {
                    "row_index": frame["row_index"].to_numpy(),
                    "text": [t for t, _ in done],
                    "status": [s for _, s in done],
                }
            )

    narrow = df.select(F.col(index).cast("bigint").alias("row_index"), F.col(col).alias("text"))
    return narrow.mapInPandas(run, "row_index bigint, text string, status string")


def enrich_resumable(
    df: DataFrame,
    col: str,
    fn: Translate,
    path: str,
    hop: str,
    shard_rows: int = 10_000,
    shards_per_job: int = 1_000,
    retry: int = 1,
    tasks: int | None = None,
    index: str = "index",
    redo_empty: bool = False,
) -> DataFrame:
    """Enrich the rows that no shard of ``hop`` under ``path`` holds yet and return the whole hop.

    Work goes in jobs of ``shards_per_job`` ranges of ``shard_rows`` indexes; each job's shards are on
    disk when it ends, so a restart repeats one job at most. Every shard is a folder: size them so that
    a corpus has thousands, not millions. The pending rows are stored once, a folder per job, so a job reads its own
    rows and no shards. ``tasks`` sets the number of concurrent callers.
    ``redo_empty`` also tries the rows again that have no text so far.
    """
    spark = df.sparkSession
    source = df.select(F.col(index).cast("bigint").alias("row_index"), F.col(col).alias("text"))

    held = read_shards(spark, path, hop)
    done = held.where(~is_empty_result("text")) if redo_empty else held
    span = shard_rows * shards_per_job
    block = (F.col("row_index") - F.pmod("row_index", F.lit(span))).alias("block")
    first = F.col("row_index") - F.pmod("row_index", F.lit(shard_rows))
    shard = F.concat_ws("-", first.cast("string"), (first + shard_rows).cast("string"))
    pending = pending_rows(source, done, "row_index").select("*", block)
    pending = materialise(pending, partition_by=["block"])
    for start in sorted(r["block"] for r in pending.select("block").distinct().collect()):
        todo = pending.where(F.col("block") == start).drop("block")
        by_shard = todo.repartition(tasks, shard) if tasks else todo.repartition(shard)
        (
            enrich_column(by_shard, "text", fn, retry, "row_index")
            .withColumns({"hop": F.lit(hop), "shard": shard})
            .write.mode("append")
            .partitionBy("hop", "shard")
            .parquet(path)
        )
    return assemble_hop(read_shards(spark, path, hop))


def union_shards(*shards: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, shards)


def crowded_intervals(shards: DataFrame) -> DataFrame:
    """``hop, shard, crowded``: per shard the parts of its range that another shard covers too, or all of it if it holds a row
    twice, as an array of ``start, stop``.

    A range goes from a shard's first row to its last. The starts and stops of a hop's shards cut the line into elementary intervals; a running sum tells how many shards lie
    over each. Only shard names are sorted, and only row numbers are counted.
    """
    ranges = shards.groupBy("hop", "shard").agg(F.min("row_index").alias("start"), (F.max("row_index") + 1).alias("stop"))
    ranges = materialise(ranges)
    ends = [F.struct(F.col(c).alias("edge"), F.lit(step).alias("step")) for c, step in (("start", 1), ("stop", -1))]
    steps = ranges.select("hop", F.explode(F.array(*ends)).alias("e")).groupBy("hop", "e.edge").agg(F.sum("e.step").alias("step"))
    line = W.partitionBy("hop").orderBy("edge")
    over = steps.select(
        "hop", "edge", F.lead("edge").over(line).alias("next"), F.sum("step").over(line).alias("over")
    ).where("over > 1")
    # An elementary interval lies in a shard or outside of it, as a whole.
    met = ranges.alias("r").join(over.alias("o"), F.expr("r.hop = o.hop and o.edge >= r.start and o.next <= r.stop"))
    met = met.select("r.hop", "r.shard", F.struct(F.col("o.edge").alias("start"), F.col("o.next").alias("stop")).alias("part"))
    twice = shards.groupBy("hop", "shard", "row_index").count().where("count > 1").select("hop", "shard").distinct()
    whole = F.struct(F.lit(-(1 << 63)).alias("start"), F.lit((1 << 63) - 1).alias("stop"))
    parts = met.unionByName(twice.select("hop", "shard", whole.alias("part")))
    return parts.groupBy("hop", "shard").agg(F.collect_list("part").alias("crowded"))


def resolve_overlap(shards: DataFrame) -> DataFrame:
    """One row per hop and row index: one with text before one without, then the widest range.

    Only rows of intervals that more than one shard covers are ranked; the texts of all others stay where they are.
    """
    crowded = materialise(crowded_intervals(shards).select(F.col("hop").alias("_hop"), F.col("shard").alias("_shard"), "crowded"))
    if crowded.isEmpty():
        return shards
    # Shards are folders, thousands of them; beyond that the planner decides.
    crowded = F.broadcast(crowded) if crowded.count() <= MAX_SHARDS else crowded
    rows = shards.join(crowded, (F.col("hop") == F.col("_hop")) & (F.col("shard") == F.col("_shard")), "left")
    inside = F.exists("crowded", lambda c: (F.col("row_index") >= c["start"]) & (F.col("row_index") < c["stop"]))
    rows = rows.select(*shards.columns, F.coalesce(inside, F.lit(False)).alias("_several"))
    bounds = F.split("shard", "-")
    width = bounds[1].cast("bigint") - bounds[0].cast("bigint")
    best = W.partitionBy("hop", "row_index").orderBy(
        is_empty_result("text").asc(), width.desc(), F.asc("shard"), F.asc("text")
    )
    ranked = rows.where("_several").withColumn("_rank", F.row_number().over(best)).where("_rank = 1")
    return rows.where("not _several").drop("_several").unionByName(ranked.drop("_rank", "_several"))


def assemble_hop(shards: DataFrame) -> DataFrame:
    """All shards of a hop as one ``row_index, text, status`` table."""
    return resolve_overlap(shards).select("row_index", "text", "status")


def failed_rows(shards: DataFrame) -> DataFrame:
    """Rows without text once overlaps are resolved."""
    return resolve_overlap(shards).where(is_empty_result("text"))


def round_trip(
    df: DataFrame,
    col: str,
    fwd: Translate,
    back: Translate,
    path: str,
    index: str = "index",
    **options: int,
) -> DataFrame:
    """Two hops over one text column, the first one on disk before the second begins.

    A row that the first hop gave no text is not sent on; it ends as ``failed``.
    """
    pivot = enrich_resumable(df, col, fwd, path, f"{col}-out", index=index, **options)
    sent = pivot.select("row_index", F.when(~is_empty_result("text"), F.col("text")).alias("text"))
    return enrich_resumable(sent, "text", back, path, f"{col}-back", index="row_index", **options)


def augmented_pairs(
    pairs: DataFrame, premise_rt: DataFrame, hypothesis_rt: DataFrame, index: str = "index"
) -> DataFrame:
    """Round-tripped texts as more pairs under the old label and index, ``source`` = ``rtt``.

    Both sides must have text and at least one must differ from its source once both are cleaned.
    Folds belong to the originals: join them by index, so no row is validated on its own round trip.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.where(~is_empty_result("text") & (F.col("status") == "ok")).select(
            F.col("row_index").alias(index), F.col("text").alias(name)
        )

    joined = pairs.join(side(premise_rt, "_premise"), index).join(side(hypothesis_rt, "_hypothesis"), index)
    # Equal texts are equal once cleaned, which is the dear part.
    changed = [(F.col(c) != F.col(f"_{c}")) & (clean_text(c) != clean_text(f"_{c}")) for c in ("premise", "hypothesis")]
    return joined.where(changed[0] | changed[1]).select(
        F.lit("rtt").alias("source"),
        index,
        F.col("_premise").alias("premise"),
        F.col("_hypothesis").alias("hypothesis"),
        "label",
    )
