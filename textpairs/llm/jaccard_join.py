"""Near-duplicate documents by an exact Jaccard join of word n-grams, with overlaps counted per fragment.

The order of all n-grams (by how many texts hold them, then by hash) decides which pairs can link at all; the hash
range is cut into fragments, the overlap of a pair is counted in each fragment apart, and the counts are summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpairs.llm.common import UPPER, col, partitions
from textpairs.llm.components import components
from textpairs.storage import materialise

WIDTH = 5
PERCENT = 80
FRAGMENTS = 4
ZONE = 3  # the lowest 1/3 of the hash range is counted to find texts that cannot link
CACHED_WORDS = 50_000
CHUNK_BYTES = 4 << 20
FOLD = str.maketrans(UPPER, UPPER.lower())


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, hashes: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams; one for a shorter text, none without words."""
    found = (text or "").translate(FOLD).encode().split()
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, found), dtype=np.uint64, count=n)
    if n < width:
        total = np.uint64(n)
        for x in w:
            total = _mix(np.array([total ^ x], np.uint64))[0]
        return np.array([total], np.uint64)
    total = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        total = _mix(total ^ w[i : n - width + 1 + i])
    return np.unique(total)


def max_missing(n: np.ndarray | int) -> np.ndarray | int:
    """How many n-grams of a set of ``n`` a linked set may lack: an overlap is at least 80 % of either set."""
    return n - (PERCENT * n + 99) // 100


def least_overlap(n: int | np.ndarray, m: int | np.ndarray) -> int | np.ndarray:
    """Smallest overlap of linked sets of ``n`` and ``m``: 100 i >= 80 (n + m - i)."""
    return (PERCENT * (n + m) + 99 + PERCENT) // (100 + PERCENT)


def _blocks(sets: list[np.ndarray], buckets: int, zone: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The n-grams of many texts by bucket of the hash range: (bucket, its width, sorted hashes, index of the text)."""
    if not sets:
        return
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])
    step = ((1 << 64) // zone) // buckets + 1
    low = every < np.uint64(min(step * buckets, (1 << 64) - 1))
    every, owner = every[low], owner[low]
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    bucket = every // np.uint64(step)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    for b in range(buckets):
        lo, hi = cuts[b], cuts[b + 1]
        if lo < hi:
            yield b, step, every[lo:hi], owner[lo:hi]


ZONE_BLOCK = "bucket int, places binary, owners binary, ids array<bigint>, bodies array<bigint>, sizes array<bigint>"


def _zone_blocks(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        owners, sets, held = [], [], 0

        def flush():
            rows = []
            n = np.array([len(s) for s in sets], np.int64)
            ids = np.array([o[0] for o in owners], np.int64)
            bodies = np.array([o[1] for o in owners], np.int64)
            for b, step, grams, owner in _blocks(sets, buckets, ZONE):
                # 32 bits tell the n-grams of a bucket apart, since buckets grow in number with the data. Two that do
                # meet count as shared, which may keep a text that could be left out and never the other way.
                place = ((grams - np.uint64(b * step)) // np.uint64(step // (1 << 32) + 1)).astype(np.uint32)
                # An n-gram twice in this chunk is known to be shared: it is sent once, without owner.
                first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
                alone = np.diff(np.r_[first, len(place)]) == 1
                used, index = np.unique(owner[first][alone], return_inverse=True)
                index_all = np.full(len(first), 0xFFFFFFFF, np.uint32)
                index_all[alone] = index
                rows.append((b, place[first].tobytes(), index_all.tobytes(), ids[used], bodies[used], n[used]))
            return _batch(rows, ["bucket", "places", "owners", "ids", "bodies", "sizes"])

        for batch in batches:
            for doc, body, text in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2), strict=True):
                found = shingles(text.as_py(), hashes)
                if len(found):
                    owners.append((doc, body))
                    sets.append(found)
                    held += 8 * len(found) + 64
                if held >= CHUNK_BYTES:
                    yield flush()
                    owners, sets, held = [], [], 0
        if sets:
            yield flush()

    return run


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.int32(), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 3]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _by_first(batches: Iterator[pa.RecordBatch], **packed: type) -> dict[int, list[dict[str, np.ndarray]]]:
    """The rows by their first column, the others as arrays over the batch's own memory: no Python object per value."""
    out: dict[int, list[dict[str, np.ndarray]]] = {}
    for batch in batches:
        names = batch.schema.names[1:]
        for at, first in enumerate(batch.column(0).to_pylist()):
            row = {}
            for name in names:
                value = batch.column(name)[at]
                if name in packed:
                    row[name] = np.frombuffer(value.as_buffer(), packed[name])
                else:
                    row[name] = value.values.to_numpy(zero_copy_only=False)
            out.setdefault(first, []).append(row)
    return out


def _count_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text, how many counted n-grams no other text holds; reads the blocks of some buckets."""
    by_bucket = _by_first(batches, places=np.uint32, owners=np.uint32)
    while by_bucket:
        _, blocks = by_bucket.popitem()
        place = np.concatenate([b["places"] for b in blocks])
        counts = [len(b["ids"]) for b in blocks]
        starts = np.r_[0, np.cumsum(counts)]
        owner = np.concatenate(
            [
                np.where(b["owners"] == 0xFFFFFFFF, -1, b["owners"].astype(np.int64) + s)
                for b, s in zip(blocks, starts, strict=False)
            ]
        )
        order = np.argsort(place, kind="stable")
        place, owner = place[order], owner[order]
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        alone = owner[first][np.diff(np.r_[first, len(place)]) == 1]
        total = np.bincount(alone[alone >= 0], minlength=int(starts[-1]))
        some = np.flatnonzero(total)
        gathered = [np.concatenate([b[c] for b in blocks])[some] for c in ("ids", "bodies", "sizes")]
        yield pa.RecordBatch.from_arrays(
            [*map(pa.array, gathered), pa.array(total[some])], names=["key", "body", "n", "alone"]
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("grams", pa.binary())])
    for batch in batches:
        rows, held = [], 0
        for doc, n, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if n is not None:
                rows.append((doc, n, None, None))
                continue
            found = shingles(text.as_py(), hashes)
            data = found.tobytes()
            digest = xxhash.xxh3_128_digest(data) if len(found) else None
            rows.append((doc, len(found), digest, data if digest else None))
            held += len(data)
            if held >= CHUNK_BYTES:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)


GRAM_BLOCK = "bucket int, grams binary, owners binary, nodes array<bigint>"


def _gram_blocks(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(nodes, sets):
            rows = []
            for b, _, grams, owner in _blocks(sets, buckets, 1):
                used, index = np.unique(owner, return_inverse=True)
                rows.append((b, grams.tobytes(), index.astype(np.uint32).tobytes(), np.array(nodes, np.int64)[used]))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            types = [pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["bucket", "grams", "owners", "nodes"]
            )

        nodes, sets, held = [], [], 0
        for batch in batches:
            for node, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                nodes.append(node)
                sets.append(np.frombuffer(data.as_py(), np.uint64))
                held += 8 * len(sets[-1]) + 64
                if held >= CHUNK_BYTES:
                    yield flush(nodes, sets)
                    nodes, sets, held = [], [], 0
        if sets:
            yield flush(nodes, sets)

    return run


SHARED = "part int, nodes array<bigint>, sizes binary, grams binary, counts binary"


def _frequencies(parts: int):
    """Of the texts in some buckets the n-grams that other texts hold too, packed by the part their node falls into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket = _by_first(batches, grams=np.uint64, owners=np.uint32)
        found = []
        while by_bucket:
            _, blocks = by_bucket.popitem()
            gram = np.concatenate([b["grams"] for b in blocks])
            nodes = np.concatenate([b["nodes"] for b in blocks])
            starts = np.r_[0, np.cumsum([len(b["nodes"]) for b in blocks])]
            owner = np.concatenate([b["owners"].astype(np.int64) + s for b, s in zip(blocks, starts, strict=False)])
            _, inverse, count = np.unique(gram, return_inverse=True, return_counts=True)
            count = count[inverse]
            shared = count > 1
            found.append((gram[shared], nodes[owner[shared]], count[shared].astype(np.uint32)))
        if not found:
            return
        gram, node, count = map(np.concatenate, zip(*found, strict=True))
        del found
        part = (_mix(node.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((node, part))
        gram, node, count, part = gram[order], node[order], count[order], part[order]
        cuts = np.searchsorted(part, np.arange(parts + 1))
        rows = []
        for k in range(parts):
            some = slice(cuts[k], cuts[k + 1])
            if cuts[k] < cuts[k + 1]:
                names, sizes = np.unique(node[some], return_counts=True)
                packed = (sizes.astype(np.uint32).tobytes(), gram[some].tobytes(), count[some].tobytes())
                rows.append((k, names, *packed))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        types = [pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 3]
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["part", "nodes", "sizes", "grams", "counts"])

    return run


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, grams``: the shared n-grams of the texts in some parts in the global order, rarest first."""
    by_part = _by_first(batches, sizes=np.uint32, grams=np.uint64, counts=np.uint32)
    while by_part:
        _, blocks = by_part.popitem()
        sizes = np.concatenate([b["sizes"] for b in blocks])
        node = np.repeat(np.concatenate([b["nodes"] for b in blocks]), sizes)
        gram = np.concatenate([b["grams"] for b in blocks])
        count = np.concatenate([b["counts"] for b in blocks])
        order = np.lexsort((gram, count, node))
        node, gram = node[order], gram[order].view(np.int64)
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        ends = np.r_[first, len(node)]
        for at in range(0, len(first), 5_000):
            some = ends[at : at + 5_001]
            grams = pa.ListArray.from_arrays(pa.array(some - some[0], pa.int32()), pa.array(gram[some[0] : some[-1]]))
            yield pa.RecordBatch.from_arrays([pa.array(node[some[:-1]]), grams], names=["node", "grams"])


def _overlapping(pairs: DataFrame, core: DataFrame) -> DataFrame:
    """The pairs ``a, na, b, nb`` that link: partial overlaps counted per fragment of the hash range and summed."""
    shift = 64 - (FRAGMENTS - 1).bit_length()
    fragment = F.shiftrightunsigned("gram", shift).cast("int")
    cut = core.select("node", F.explode("grams").alias("gram")).groupBy("node", fragment.alias("f"))
    parts = materialise(cut.agg(F.collect_list("gram").alias("part")))
    left = pairs.join(parts.select(F.col("node").alias("a"), "f", F.col("part").alias("pa")), "a")
    both = left.join(parts.select(F.col("node").alias("b"), "f", F.col("part").alias("pb")), ["b", "f"])
    common = F.size(F.array_intersect("pa", "pb"))
    summed = both.select("a", "na", "b", "nb", common.alias("c")).groupBy("a", "na", "b", "nb").agg(F.sum("c").alias("c"))
    return summed.where((100 + PERCENT) * F.col("c") >= PERCENT * (F.col("na") + F.col("nb"))).select("a", "b")


def _links(core: DataFrame) -> DataFrame:
    """Links ``a, b`` that give the same components as all links between the sets of ``core``.

    Of two linked sets the smaller one shares an n-gram among its first ``n - o(n, n) + 1`` and the larger one among
    its first ``n - 0.8 n + 1``, ``o`` being the least overlap. In the first round every set is compared with one
    other: of the sets that come first in its n-grams' lists the one that does so most often. Sets joined by it are
    not compared again, so a group of near copies costs as many pairs as it has members. The second round compares
    all sets that share such an n-gram and are not yet joined.
    """
    missing = F.col("n") - F.ceil(F.col("n") * PERCENT / 100).cast("bigint")
    own = F.col("n") - F.expr(f"({2 * PERCENT} * n + {99 + PERCENT}) div {100 + PERCENT}")
    some = core.select("node", "n", "alone", own.alias("own"), F.posexplode(F.slice("grams", F.lit(1), F.greatest(missing + 1 - F.col("alone"), F.lit(0)).cast("int"))).alias("at", "gram"))
    prefix = some.select("gram", "node", "n", (F.col("at") + F.col("alone")).alias("at"), "own")
    prefix = materialise(prefix)
    first = prefix.groupBy("gram").agg(F.min(F.struct("at", "node", "n")).alias("p"))
    met = prefix.join(first.select("gram", F.col("p.node").alias("b"), F.col("p.n").alias("nb")), "gram")
    near = (PERCENT * F.col("n") <= 100 * F.col("nb")) & (PERCENT * F.col("nb") <= 100 * F.col("n"))
    votes = met.where((F.col("node") != F.col("b")) & near).groupBy("node", "n", "b", "nb").agg(F.count("*").alias("votes"))
    chosen = votes.groupBy("node", "n").agg(F.max(F.struct("votes", "b", "nb")).alias("c"))
    pairs = chosen.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("c.b").alias("b"), F.col("c.nb").alias("nb"))
    one = materialise(_overlapping(pairs, core))
    joined = materialise(components(one))

    named = prefix.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = named.groupBy("gram").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("gram")
    named = materialise(named.join(mixed, "gram"))
    small, large = named.where("at <= own").alias("s"), named.alias("l")
    need = F.expr(f"({PERCENT} * (s.n + l.n) + {99 + PERCENT}) div {100 + PERCENT}")
    pairs = small.join(
        large,
        F.expr(
            f"s.gram = l.gram and s.root <> l.root and (s.n < l.n or s.n = l.n and s.node < l.node) "
            f"and {PERCENT} * l.n <= 100 * s.n"
        )
        & (F.least(F.expr("s.n - s.at"), F.expr("l.n - l.at")) >= need),
    ).select(F.expr("s.node").alias("a"), F.expr("s.n").alias("na"), F.expr("l.node").alias("b"), F.expr("l.n").alias("nb"))
    return one.unionByName(materialise(_overlapping(pairs.distinct(), core)))


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    r"""Every document with its number of distinct word 5-grams and its class of near copies.

    Words are runs of characters other than ``[\x20\x09-\x0D]`` with A-Z lower-cased; a shorter text is one n-gram.
    Two documents link when the Jaccard similarity of their sets is 0.8 or more; a class is what links join. Returns
    ``doc_id, n_shingles, component_id`` (the smallest id of the class).

    Texts whose unshared n-grams alone rule out a partner are found first, by the blocks of one third of the hash
    range; equal sets are one set from then on. Null, empty or blank texts have no n-grams and are alone. Rows that
    repeat an id keep their own text's class; a row without id takes part, but names a class only if no row of it has
    an id (then the class is null). An empty table gives no rows; other columns are left out.
    """
    spark = docs.sparkSession
    tasks = partitions(spark)
    buckets = 4 * tasks
    rows = docs.select(col(key).cast("bigint").alias("doc_id"), F.xxhash64(col(text)).alias("body"), col(text).alias("text"))
    known = rows.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), "body", "text")
    blocks = known.mapInArrow(_zone_blocks(buckets), ZONE_BLOCK).repartition(tasks, "bucket")
    counted = blocks.mapInArrow(_count_alone, "key bigint, body bigint, n bigint, alone bigint")
    alone = counted.groupBy("key", "body", "n").agg(F.sum("alone").alias("alone"))
    single = alone.where(F.col("alone") > F.col("n") - F.ceil(F.col("n") * PERCENT / 100)).select("key", "body", "n")
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    left = rows.join(single.groupBy("key", "body").agg(F.min("n").alias("n")), ["key", "body"], "left").select("doc_id", "n", "text")
    sets = materialise(left.mapInArrow(_sets, "doc_id bigint, n bigint, digest binary, grams binary"))

    groups = sets.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least"))
    groups = materialise(groups.withColumn("node", F.monotonically_increasing_id()))
    kept = sets.where("digest is not null").select("doc_id", "n", "digest", "grams")
    one = kept.join(groups, (kept["digest"] == groups["digest"]) & kept["doc_id"].eqNullSafe(groups["least"]))
    one = one.select("node", "n", kept["grams"]).dropDuplicates(["node"])
    one = materialise(one)
    blocks = one.select("node", "grams").mapInArrow(_gram_blocks(buckets), GRAM_BLOCK).repartition(tasks, "bucket")
    shared = blocks.mapInArrow(_frequencies(2 * tasks), SHARED).repartition(tasks, "part")
    shared = shared.mapInArrow(_ordered, "node bigint, grams array<bigint>")
    core = one.select("node", "n").join(shared, "node").withColumn("alone", F.col("n") - F.size("grams"))
    # A text with more unshared n-grams than a linked one may miss is left out.
    core = materialise(core.where(F.col("alone") <= F.col("n") - F.ceil(F.col("n") * PERCENT / 100)))

    roots = components(_links(core))
    named = groups.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialise(named.join(least, "root").select("digest", "component_id"))
    # Apart, so that the many texts without a digest are no key of the join.
    alone = sets.where("digest is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    found = sets.where("digest is not null").join(classes, "digest").select("doc_id", "n", "component_id")
    return found.unionByName(alone).withColumnRenamed("n", "n_shingles")
