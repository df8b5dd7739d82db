"""Chat texts of maximal conversations: logged snapshots that a longer log begins with are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textpairs.llm.common import col, digest
from textpairs.storage import materialise

START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    """No text can open or close a turn."""
    return F.replace(text, F.lit("<|im_"), F.lit("<| im_"))


def turn_text(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), escaped(role), F.lit("\n"), escaped(text), F.lit(END + "\n"))


def format_conversations(
    turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv_id, n_turns, text`` of every conversation that no other one begins with.

    The hash of a conversation's first k turns rolls on from turn to turn. A conversation is left out if its whole hash is
    the hash of the first turns of a longer one, or the whole hash of one with a smaller id; the longest of equal
    beginnings and the smallest id are counted per hash before anything is joined, so a first turn that most
    conversations share is one row.

    Turns are ordered by number (nulls first), then role, then text; gaps do not matter and a repeated row is a turn of its
    own. Null role or text counts as empty. Each row without id is a conversation of one turn; of equal ones one stays, ahead
    of equal conversations with an id. An empty table gives no rows; other columns are left out. Only the turns of one
    conversation, which make one text, meet in a task.
    """
    rows = turns.select(
        col(key).alias("conv_id"),
        col(turn).alias("turn"),
        F.coalesce(col(role), F.lit("")).alias("role"),
        F.coalesce(col(text), F.lit("")).alias("text"),
    )
    # Nothing ties rows without id together, so their content is their key.
    loose = rows.where("conv_id is null").groupBy("conv_id", "role", "text").agg(F.min("turn").alias("turn"))
    rows = rows.where("conv_id is not null").unionByName(loose)
    keys = ["conv_id", "own1", "own2"]
    unnamed = F.col("conv_id").isNull()
    own1, own2 = digest("role", "text")
    rows = rows.withColumns({"own1": F.when(unnamed, own1), "own2": F.when(unnamed, own2)})
    each = Window.partitionBy(*keys)
    numbered = rows.withColumn("k", F.row_number().over(each.orderBy("turn", "role", "text")))
    tagged = numbered.select(*keys, "k", *digest("k", *digest("role", "text")))
    # Rows, not a range of values: a repeated turn rolls the hash on by itself.
    upto = each.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = tagged.select(
        *keys, "k", F.bit_xor("h1").over(upto).alias("p1"), F.bit_xor("h2").over(upto).alias("p2"), F.count("*").over(each).alias("n")
    )
    rolled = materialise(rolled)
    ends = F.col("k") == F.col("n")
    heads = rolled.groupBy("k", "p1", "p2").agg(
        F.max("n").alias("longest"),
        F.min(F.when(ends, F.col("conv_id"))).alias("first"),
        F.max(ends & F.col("conv_id").isNull()).alias("unnamed"),
    )
    # A conversation without id comes before equal ones with an id.
    named = ~F.col("unnamed") & F.col("conv_id").eqNullSafe(F.col("first"))
    alone = (F.col("longest") == F.col("n")) & F.when(F.col("conv_id").isNull(), F.col("unnamed")).otherwise(named)
    maximal = rolled.where(ends).join(heads, ["k", "p1", "p2"]).where(alone).select(*[F.col(k).alias(f"kept_{k}") for k in keys])
    kept = rows.join(materialise(maximal), [F.col(k).eqNullSafe(F.col(f"kept_{k}")) for k in keys], "left_semi")
    grouped = kept.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    lines = F.transform("turns", lambda t: turn_text(t["role"], t["text"]))
    return grouped.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.array_join(lines, "").alias("text"))
