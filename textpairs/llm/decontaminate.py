"""Benchmark passages in documents, found by spaced seeds that let words be replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpairs.llm.common import col, fold_ascii, words
from textpairs.storage import materialise

WINDOW = 13
# Word positions that a seed reads, for items of so many words. Whichever two of 13 words in a row, or one of 9 to 12,
# are replaced, some place of a mask lies between; shorter items are read whole.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
SHORT_MASKS = ((0, 1, 3, 4),)
LENGTHS: list[tuple[int, int, tuple[tuple[int, ...], ...]]] = [
    (WINDOW, 1 << 31, MASKS),
    (9, 12, SHORT_MASKS),
    *[(m, m, (tuple(range(m)),)) for m in range(8, 0, -1)],
]
BROADCAST_SEEDS = 2_000_000


def word_hashes(text: Column) -> Column:
    return F.transform(words(fold_ascii(text)), lambda w: F.xxhash64(w))


def needed(words_: Column) -> Column:
    """Equal words that make a passage of an item's best window: all but two of 13, but one of 9 to 12, else all."""
    return F.when(words_ >= WINDOW, WINDOW - 2).when(words_ >= 9, words_ - 1).otherwise(words_)


def _seeds(df: DataFrame, lengths: list[tuple[int, int, tuple]], own: bool, *keep: str) -> DataFrame:
    """One row per place ``at`` in the word hashes ``w`` and mask, with the hash of the words that the mask reads.

    Of the masks for some lengths; ``own`` keeps to those for the length of ``w`` itself.
    """
    places = df.select(*keep, "w", F.posexplode("w").alias("at", "_"))
    seeds = []
    for low, high, masks in lengths:
        for mask in masks:
            fits = F.col("at") + mask[-1] < F.size("w")
            if own:
                fits = fits & F.size("w").between(low, high)
            read = [F.get("w", F.col("at") + offset) for offset in mask]
            seeds.append(F.when(fits, F.xxhash64(F.lit(",".join(map(str, mask))), *read)))
    return places.select(*keep, "w", "at", F.explode(F.array(*seeds)).alias("seed")).where("seed is not null")


def _overlap(doc: Column, item: Column, shift: Column) -> Column:
    """Best number of equal words in a window, and equal words in all, with ``item`` laid ``shift`` words into ``doc``."""
    start, end = F.greatest(shift, F.lit(0)), F.least(F.size(doc), shift + F.size(item))
    length = end - start
    equal = F.zip_with(
        F.slice(doc, start + 1, length), F.slice(item, start - shift + 1, length), lambda a, b: (a == b).cast("int")
    )
    window = F.least(F.lit(WINDOW), F.size(item))
    sums = F.transform(
        F.sequence(F.lit(1), F.greatest(length - window + 1, F.lit(1))),
        lambda i: F.aggregate(F.slice(equal, i, window), F.lit(0), lambda a, b: a + b),
    )
    total = F.aggregate(equal, F.lit(0), lambda a, b: a + b)
    best = F.when(length >= window, F.array_max(sums)).otherwise(0)
    return F.struct(best.alias("best"), total.alias("total"))


def find_passages(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    broadcast_seeds: int = BROADCAST_SEEDS,
) -> DataFrame:
    r"""Pairs of a document and a benchmark item that share a passage: ``doc_id, item_id, best_window, matched``.

    A passage is 13 words in a row of which at most two differ, word by word at the same places; ``best_window`` is
    the largest number of equal words in 13 and ``matched`` the number of equal words along the best alignment with a
    passage. Words are runs other than ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased. An item of 9 to 12 words must occur
    whole with at most one word replaced, one of 1 to 8 words whole and unchanged. Every place of every text is looked up;
    masks are read for the lengths that some item has.

    The seeds of the items go to every task if there are at most ``broadcast_seeds``, as their count tells; more of them
    are joined by a shuffle of place and hash alone, and only texts with a hit are fetched again.

    Null or empty texts share nothing; rows that repeat an id count as one document or item, and so do rows without id;
    an empty table gives no rows; other columns are left out.
    """
    body = F.coalesce(col(text), F.lit(""))
    rows = docs.select(col(key).alias("doc_id"), body.alias("text"))
    known = items.select(col(item_key).alias("item_id"), word_hashes(col(item_text)).alias("w")).where(F.size("w") > 0)
    known = materialise(known.distinct().withColumn("item", F.monotonically_increasing_id()))
    # One row per length at most.
    sizes = {r["n"] for r in known.select(F.least(F.size("w"), F.lit(WINDOW)).alias("n")).distinct().collect()}
    lengths = [x for x in LENGTHS if any(x[0] <= n <= x[1] for n in sizes)] or LENGTHS[:1]
    seeds = materialise(_seeds(known, lengths, True, "item").select("item", F.col("at").alias("item_at"), "seed"))
    texts = known.select("item", "item_id", F.col("w").alias("iw"))
    if seeds.count() <= broadcast_seeds:
        places = _seeds(rows.select("doc_id", word_hashes(F.col("text")).alias("w")), lengths, False, "doc_id")
        hits = places.join(F.broadcast(seeds), "seed").select("doc_id", "w", "item", (F.col("at") - F.col("item_at")).alias("shift"))
        hits = hits.join(F.broadcast(texts), "item")
    else:
        keyed = rows.select("doc_id", F.xxhash64("text").alias("body"), word_hashes(F.col("text")).alias("w"))
        places = _seeds(keyed, lengths, False, "doc_id", "body").select("doc_id", "body", "at", "seed").join(seeds, "seed")
        hits = places.select("doc_id", "body", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
        hits = hits.join(texts, "item").alias("h").join(
            keyed.alias("k"), F.expr("h.doc_id <=> k.doc_id and h.body = k.body")
        )
        hits = hits.select("h.doc_id", "k.w", "h.item_id", "h.iw", "h.shift")
    seen = hits.select("doc_id", "item_id", F.size("iw").alias("m"), _overlap(F.col("w"), F.col("iw"), F.col("shift")).alias("o"))
    found = seen.where(F.col("o.best") >= needed(F.col("m")))
    return found.groupBy("doc_id", "item_id").agg(
        F.max("o.best").cast("bigint").alias("best_window"), F.max("o.total").cast("bigint").alias("matched")
    )
