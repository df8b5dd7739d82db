"""Passages that occur earlier in the corpus, found by sorting suffixes, removed byte by byte.

Every window of ``LENGTH`` bytes is handed to one of the ``GRAM``-byte grams inside it: the one with the smallest hash.
Equal windows pick the same gram, so a window can only occur elsewhere if its gram does. Grams that occur once are
dropped by their hashes alone; around the others the text that their windows cover goes to the gram's task, which sorts
the suffixes that start at the grams, and the reversed texts before them, and reads from the common prefixes of
neighbours which windows are equal.

A gram that very many texts hold with different surroundings is split by these. Of the ``SPREAD + 1`` places that it can have
in a window the first half has the longer part of the window to the right and the second half to the left: the windows of one half
share the gram and all that any of them has on that side, so they are handed to that longer string, and again by halves where it
still is in too many different surroundings, down to single windows. Each half of a run is a row, and equal rows become one before they
are counted, so inside a shared passage one row is left and at its edge one half of each row is alone at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpairs.llm.common import col, partitions
from textpairs.llm.deep_shallow import deep_shallow_sort, neighbour_prefixes
from textpairs.storage import materialise, materialise_bucketed

LENGTH = 100
GRAM = 16
SPREAD = LENGTH - GRAM
LARGE_GROUP = 2_000
TASK_BYTES = 1 << 26
SORTED = 100_000
CHUNK = 1 << 20
PIECE = 1 << 22
LOW = np.uint64((1 << 24) - 1)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the sixteen bytes from each place on."""
    x = data.astype(np.uint64)
    x = x[:-1] | (x[1:] << np.uint64(8))
    x = x[:-2] | (x[2:] << np.uint64(16))
    x = x[:-4] | (x[4:] << np.uint64(32))
    h = x[:-8] * np.uint64(0x9E3779B97F4A7C15) ^ (x[8:] + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def window_runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of window starts with the same gram: (text, first start, last start, place of the gram, hash).

    Long texts are cut into pieces that overlap by a window less one byte, so that each window is in one piece.
    """
    pieces, held = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - LENGTH + 1, 0), PIECE):
            piece = text[at : at + PIECE + LENGTH - 1]
            pieces.append((i, at, piece))
            held += len(piece)
            if held >= CHUNK:
                yield _runs(pieces)
                pieces, held = [], 0
    if pieces:
        yield _runs(pieces)


def _runs(pieces: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(p for _, _, p in pieces) + bytes(GRAM), np.uint8)
    hashes = _gram_hashes(data)
    places = np.arange(len(hashes), dtype=np.uint64)
    least = (hashes & ~LOW) | (LOW - places)
    grams, width = LENGTH - GRAM + 1, 1
    while 2 * width <= grams:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < grams:
        least = np.minimum(least[: len(least) - (grams - width)], least[grams - width :])
    lengths = np.array([len(p) for _, _, p in pieces], np.int64)
    begins = np.cumsum(lengths) - lengths
    windows = lengths - LENGTH + 1
    starts = np.repeat(begins - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    gram = (LOW - (least[starts] & LOW)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    last = np.r_[first[1:], len(gram)] - 1
    piece = np.searchsorted(begins, starts[first], side="right") - 1
    shift = np.array([at for _, at, _ in pieces], np.int64)[piece] - begins[piece]
    text = np.array([i for i, _, _ in pieces], np.int64)[piece]
    return text, starts[first] + shift, starts[last] + shift, gram[first] + shift, hashes[gram[first]]


def _place(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the hash range and 32-bit place inside it; grams that share both are told apart when sorted."""
    step = (1 << 64) // buckets + 1
    bucket = hashes // np.uint64(step)
    place = (hashes - bucket * np.uint64(step)) // np.uint64(step // (1 << 32) + 1)
    return bucket.astype(np.int32), place.astype(np.uint32)


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


BLOCK = "bucket int, places binary, owners binary, keys array<bigint>, bodies array<bigint>"


def _gram_blocks(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bodies = (np.array(batch.column(i).to_pylist(), np.int64) for i in (0, 1))
            for text, _, _, _, hashes in window_runs(_texts(batch.column(2))):
                bucket, place = _place(hashes, buckets)
                order = np.lexsort((place, bucket))
                bucket, place, text = bucket[order], place[order], text[order]
                cuts = np.searchsorted(bucket, np.arange(buckets + 1))
                rows = []
                for b in range(buckets):
                    lo, hi = cuts[b], cuts[b + 1]
                    if lo < hi:
                        used, index = np.unique(text[lo:hi], return_inverse=True)
                        rows.append((b, place[lo:hi].tobytes(), index.astype(np.uint32).tobytes(), keys[used], bodies[used]))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 5
                types = [pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                names = ["bucket", "places", "owners", "keys", "bodies"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


PACKED = "part int, keys array<bigint>, bodies array<bigint>, sizes binary, grams binary, hot binary"


def _repeated_grams(parts: int, large: int):
    """The bucketed grams that occur again, and which of them very often, packed by the part their text falls into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [row for batch in batches for row in batch.to_pylist()]
        if not blocks:
            return
        gram = np.concatenate(
            [(np.uint64(b["bucket"]) << np.uint64(32)) | np.frombuffer(b["places"], np.uint32).astype(np.uint64) for b in blocks]
        )
        keys, bodies = (np.concatenate([np.array(b[c], np.int64) for b in blocks]) for c in ("keys", "bodies"))
        starts = np.r_[0, np.cumsum([len(b["keys"]) for b in blocks])]
        owner = np.concatenate(
            [np.frombuffer(b["owners"], np.uint32).astype(np.int64) + s for b, s in zip(blocks, starts, strict=False)]
        )
        _, inverse, count = np.unique(gram, return_inverse=True, return_counts=True)
        count = count[inverse]
        again = count > 1
        gram, owner, hot = gram[again], owner[again], (count[again] > large).astype(np.uint8)
        part = ((keys ^ bodies).view(np.uint64) % np.uint64(parts)).astype(np.int64)[owner]
        order = np.lexsort((owner, part))
        gram, owner, hot, part = gram[order], owner[order], hot[order], part[order]
        cuts = np.searchsorted(part, np.arange(parts + 1))
        rows = []
        for k in range(parts):
            some = slice(cuts[k], cuts[k + 1])
            if cuts[k] < cuts[k + 1]:
                who, sizes = np.unique(owner[some], return_counts=True)
                packed = (sizes.astype(np.uint32).tobytes(), gram[some].tobytes(), hot[some].tobytes())
                rows.append((k, keys[who], bodies[who], *packed))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        types = [pa.int32(), *[pa.list_(pa.int64())] * 2, *[pa.binary()] * 3]
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["part", "keys", "bodies", "sizes", "grams", "hot"])

    return run


def _by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, body, grams, hot``, one row per text of some parts."""
    blocks = [row for batch in batches for row in batch.to_pylist()]
    if not blocks:
        return
    sizes = np.concatenate([np.frombuffer(b["sizes"], np.uint32) for b in blocks])
    key, body = (np.repeat(np.concatenate([np.array(b[c], np.int64) for b in blocks]), sizes) for c in ("keys", "bodies"))
    gram = np.concatenate([np.frombuffer(b["grams"], np.uint64) for b in blocks])
    hot = np.concatenate([np.frombuffer(b["hot"], np.uint8) for b in blocks]).astype(bool)
    order = np.lexsort((body, key))
    key, body, gram, hot = key[order], body[order], gram[order], hot[order]
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (body[1:] != body[:-1])])
    last = np.r_[first[1:], len(key)]
    for at in range(0, len(first), 5_000):
        some = slice(at, at + 5_000)
        spans = list(zip(first[some], last[some], strict=True))
        grams = pa.array([gram[a:b].tobytes() for a, b in spans], pa.binary())
        often = pa.array([gram[a:b][hot[a:b]].tobytes() for a, b in spans], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[first[some]]), pa.array(body[first[some]]), grams, often], names=["key", "body", "grams", "hot"]
        )


TEXT_RUNS = (
    "doc_id bigint, key bigint, body bigint, text binary, lo array<bigint>, hi array<bigint>, gram array<bigint>, "
    "hot array<boolean>"
)


def _text_runs(buckets: int):
    """Each text with the runs of windows whose gram occurs again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = _texts(part.column(3))
                grams, hots = (
                    [None if g is None else np.frombuffer(g, np.uint64) for g in part.column(c).to_pylist()] for c in (4, 5)
                )
                found = [([], [], [], []) for _ in texts]
                for text, lo, hi, gram, hashes in window_runs([t if g is not None else b"" for t, g in zip(texts, grams, strict=True)]):
                    bucket, place = _place(hashes, buckets)
                    name = (bucket.astype(np.uint64) << np.uint64(32)) | place.astype(np.uint64)
                    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
                    for i in np.unique(text):
                        a, b = cuts[i], cuts[i + 1]
                        again = np.isin(name[a:b], grams[i])
                        often = np.isin(name[a:b], hots[i])
                        for out, values in zip(found[i], (lo[a:b], hi[a:b], gram[a:b], often), strict=True):
                            out.append(values[again])
                joined = [[np.concatenate(v) if v else np.empty(0, np.int64) for v in f] for f in found]
                columns = [pa.array([j[k] for j in joined], pa.list_(pa.int64())) for k in range(3)]
                columns.append(pa.array([j[3].astype(bool) for j in joined], pa.list_(pa.bool_())))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(texts, pa.binary()), *columns],
                    names=["doc_id", "key", "body", "text", "lo", "hi", "gram", "hot"],
                )

    return run


CONTEXTS = "context binary, at int, key bigint, body bigint, lo bigint"


def _contexts(hot: bool):
    """The bytes that a run's windows cover, once per batch and kind, at the earliest place; for frequent grams or the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                first: dict[tuple[bytes, int], tuple[int, int, int]] = {}
                for row in batch.slice(at, 4096).to_pylist():
                    text = row["text"]
                    for lo, hi, gram, often in zip(row["lo"], row["hi"], row["gram"], row["hot"], strict=True):
                        if often == hot:
                            what, place = (text[lo : hi + LENGTH], gram - lo), (row["key"], row["body"], lo)
                            if what not in first or place < first[what]:
                                first[what] = place
                places = list(zip(*first.values(), strict=True)) if first else [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([c for c, _ in first], pa.binary()),
                        pa.array([o for _, o in first], pa.int32()),
                        *[pa.array(p, pa.int64()) for p in places],
                    ],
                    names=["context", "at", "key", "body", "lo"],
                )

    return run


def _grouped(contexts: DataFrame) -> DataFrame:
    """With the group that sorts a context: the hash of what its windows have in common, the gram or more."""
    common = F.substring("context", F.col("at") - F.col("low") + 1, LENGTH - F.col("high") + F.col("low"))
    return contexts.withColumn("group", F.xxhash64("low", "high", common))


def _split(contexts: DataFrame) -> DataFrame:
    """Each context as its windows of the lower half of the gram's places, and those of the upper half."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    halves = F.array(
        F.struct(F.col("low").alias("x"), middle.alias("y")), F.struct((middle + 1).alias("x"), F.col("high").alias("y"))
    )
    rows = contexts.withColumn("half", F.explode(halves))
    nearest = F.greatest(F.col("at") - F.octet_length("context") + LENGTH, F.col("half.x"))
    farthest = F.least(F.col("at"), F.col("half.y"))
    rows = rows.withColumns({"near": nearest, "far": farthest}).where("near <= far")
    return rows.select(
        F.substring("context", F.col("at") - F.col("far") + 1, F.col("far") - F.col("near") + LENGTH).alias("context"),
        F.col("far").alias("at"),
        "key",
        "body",
        (F.col("lo") + F.col("at") - F.col("far")).alias("lo"),
        F.col("half.x").alias("low"),
        F.col("half.y").alias("high"),
    )


def _first_of_each(contexts: DataFrame) -> DataFrame:
    """Equal contexts once, at their earliest place; combined in each task before they are shuffled."""
    place = F.min(F.struct("key", "body", "lo")).alias("f")
    return contexts.groupBy("context", "at", "low", "high").agg(place).select("context", "at", "f.*", "low", "high")


def _small_groups(contexts: DataFrame, large: int) -> tuple[DataFrame, list[DataFrame]]:
    """The contexts of frequent grams in groups of at most ``large``, and the parts that were halved on the way there.

    Eight rounds at most: by then a part is a single window and its group one row.
    """
    small, halved = [], []
    contexts = contexts.withColumns({"low": F.lit(0), "high": F.lit(SPREAD)})
    while True:
        rows = materialise(_grouped(_first_of_each(contexts)))
        many = materialise(rows.groupBy("group").count().where(F.col("count") > large).select("group"))
        if many.isEmpty():
            small.append(rows)
            return reduce(DataFrame.unionByName, small), halved
        small.append(rows.join(many, "group", "left_anti"))
        contexts = rows.join(many, "group", "left_semi").drop("group")
        halved.append(contexts.select("key", "body", "lo", "low", "high"))
        contexts = _split(contexts)


def earlier_windows(contexts: list[bytes], at: list[int], places: list[tuple]) -> list[tuple[int, int, int]]:
    """For each distinct context, at its earliest place: (index, nearest, farthest) window start before the gram that
    occurs earlier, both -1 if none does. ``at`` is the gram's place in the context.
    """
    first: dict[tuple[bytes, int], int] = {}
    for i in sorted(range(len(contexts)), key=places.__getitem__):
        first.setdefault((contexts[i], at[i]), i)
    which = list(first.values())  # by place
    n = len(which)
    right = [contexts[i][at[i] :] for i in which]
    left = [contexts[i][: at[i]][::-1] for i in which]
    classes = []
    for strings in (right, left):
        order = deep_shallow_sort(strings)
        classes.append((order, neighbour_prefixes(strings, order)))
    far = np.array([at[i] for i in which], np.int64)
    near = far - np.array([len(contexts[i]) - LENGTH for i in which], np.int64)
    nearest, farthest = np.full(n, -1), np.full(n, -1)
    ids = [np.empty(n, np.int64), np.empty(n, np.int64)]
    (order_r, common_r), (order_l, common_l) = classes
    for before in range(int(far.max(initial=-1)) + 1):
        ids[0][order_r] = np.cumsum(common_r < LENGTH - before)
        ids[1][order_l] = np.cumsum(common_l < before)
        some = np.flatnonzero((near <= before) & (before <= far))
        both = ids[0][some] * (n + 1) + ids[1][some]
        by = np.argsort(both, kind="stable")  # earliest first inside a class
        again = some[by[1:][both[by[1:]] == both[by[:-1]]]]
        nearest[again[nearest[again] < 0]] = before
        farthest[again] = before
    return list(zip(which, nearest.tolist(), farthest.tolist(), strict=True))


JUDGED = "key bigint, body bigint, lo bigint, low int, high int, near int, far int"


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts come ordered by group; as many whole groups as ``SORTED`` contexts make are sorted together."""
    held: list[tuple] = []

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        found = earlier_windows([r[1] for r in rows], [r[2] for r in rows], [r[3:6] for r in rows])
        out = [(*rows[i][3:8], near, far) for i, near, far in found]
        types = [*[pa.int64()] * 3, *[pa.int32()] * 4]
        names = ["key", "body", "lo", "low", "high", "near", "far"]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if len(held) >= SORTED and row[0] != held[-1][0]:
                yield settle(held)
                held = []
            held.append(row)
    if held:
        yield settle(held)


KEPT = "doc_id bigint, n_bytes bigint, removed array<struct<start:bigint,end:bigint>>, kept binary"


def _repeated_spans(lo: int, hi: int, gram: int, known: dict, low: int = 0, high: int = SPREAD) -> list[tuple[int, int]]:
    """Spans of a run's windows that occur earlier, from what is known of the run or of its halves."""
    near, far = max(gram - hi, low), min(gram - lo, high)
    if near > far:
        return []
    at = gram - far, low, high
    if at not in known:
        return [(gram - far, gram - near + LENGTH)]
    if known[at][0] is None:
        middle = (low + high) // 2
        return _repeated_spans(lo, hi, gram, known, low, middle) + _repeated_spans(lo, hi, gram, known, middle + 1, high)
    near, far = known[at]
    return [(gram - far, gram - near + LENGTH)] if far >= 0 else []


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the bytes of repeated windows; what is not known to be first in its kind is repeated."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            rows = []
            for row in batch.slice(at, 512).to_pylist():
                text = row["text"]
                change = np.zeros(len(text) + 1, np.int32)
                known = {(f["lo"], f["low"], f["high"]): (f["near"], f["far"]) for f in row["firsts"] or ()}
                for lo, hi, gram in zip(row["lo"], row["hi"], row["gram"], strict=True):
                    for start, end in _repeated_spans(lo, hi, gram, known):
                        change[start] += 1
                        change[end] -= 1
                gone = np.r_[False, np.cumsum(change[:-1]) > 0, False]
                edges = np.flatnonzero(gone[1:] != gone[:-1]).tolist()
                removed = [{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]
                keep, last = [], 0
                for span in removed:
                    keep.append(text[last : span["start"]])
                    last = span["end"]
                rows.append((row["doc_id"], len(text), removed, b"".join([*keep, text[last:]])))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            types = [pa.int64(), pa.int64(), span, pa.binary()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            names = ["doc_id", "n_bytes", "removed", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", large: int = LARGE_GROUP) -> DataFrame:
    """Every document without the bytes of 100-byte strings that also start earlier.

    Earlier is a smaller id, or a smaller start in the same document; strings are judged on the whole input, and
    overlapping occurrences count. Returns ``doc_id, n_bytes, removed`` (maximal runs of removed bytes) and ``kept``
    (the bytes left, which need not be valid UTF-8).

    Grams that occur more than ``large`` times are split by their surroundings until none is in more than ``large`` different
    ones, so no task is given an unbounded group; every window goes through the sort of suffixes. Null text is empty. Rows without id come before all others. Rows that repeat an id are told apart by their
    text, in an arbitrary but fixed order; of rows equal in both each is judged like the other. An empty table gives no
    rows; other columns are left out.
    """
    spark = docs.sparkSession
    rows = docs.select(col(key).cast("bigint").alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("bigint")).alias("n")).first()["n"] or 0
    tasks = max(partitions(spark), -(-size // TASK_BYTES))
    buckets = 4 * tasks
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), F.xxhash64("text").alias("body"), "text")
    blocks = rows.select("key", "body", "text").mapInArrow(_gram_blocks(buckets), BLOCK).repartition(tasks, "bucket")
    again = blocks.mapInArrow(_repeated_grams(2 * tasks, large), PACKED).repartition(tasks, "part")
    again = again.mapInArrow(_by_text, "key bigint, body bigint, grams binary, hot binary")
    placed = rows.join(again, ["key", "body"], "left").select("doc_id", "key", "body", "text", "grams", "hot")
    texts = materialise_bucketed(placed.mapInArrow(_text_runs(buckets), TEXT_RUNS), tasks, "key", "body")

    runs = ["key", "body", "text", "lo", "hi", "gram", "hot"]
    rare = texts.where(F.exists("hot", lambda h: ~h)).select(*runs).mapInArrow(_contexts(False), CONTEXTS)
    often = texts.where(F.exists("hot", lambda h: h)).select(*runs).mapInArrow(_contexts(True), CONTEXTS)
    small, halved = _small_groups(often, large)
    columns = ["group", "context", "at", "key", "body", "lo", "low", "high"]
    every = _grouped(rare.withColumns({"low": F.lit(0), "high": F.lit(SPREAD)})).select(*columns).unionByName(small.select(*columns))
    judged = every.repartition(tasks, "group").sortWithinPartitions("group").mapInArrow(_judged, JUDGED)
    none = F.lit(None).cast("int")
    for parts in halved:
        judged = judged.unionByName(parts.withColumns({"near": none, "far": none}))
    firsts = judged.groupBy("key", "body").agg(F.collect_list(F.struct("lo", "low", "high", "near", "far")).alias("firsts"))
    joined = texts.join(firsts, ["key", "body"], "left")
    return joined.select("doc_id", "text", "lo", "hi", "gram", "firsts").mapInArrow(_cut, KEPT)
