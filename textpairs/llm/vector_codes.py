"""Product codes of vectors: each part gets its nearest codebook entry, of which only those that may win in its grid cell are evaluated."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpairs.llm.common import col, partitions
from textpairs.storage import materialise

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LARGEST = 1 << 24
CELLS = 50_000
BLOCK = 1 << 21


class NearestEntry:
    """Nearest entry of one codebook for many integer vectors, ties to the smaller index.

    Vectors are hashed to the cubic cell of a grid that holds them. Over the box of a cell each entry has a least and a greatest
    distance; an entry whose least one exceeds the greatest one of some other entry is nearest nowhere in the box. The rest are kept
    per cell, ascending, and only they are evaluated. The table of cells is emptied when full.
    """

    def __init__(self, entries: np.ndarray, side: int | None = None, cells: int = CELLS):
        self.entries, self.cells = entries.astype(np.int64), cells
        self.side = side or self._side()
        self.known: dict[bytes, np.ndarray] = {}
        self.evaluated = 0

    def _side(self) -> int:
        """A cell twice as long as the usual way between entries, along each dimension."""
        if len(self.entries) < 2 or not self.entries.shape[1]:
            return 1
        apart = ((self.entries[:, None] - self.entries[None]) ** 2).sum(axis=2).astype(float)
        np.fill_diagonal(apart, np.inf)
        return max(int(np.sqrt(np.median(apart.min(axis=1)) / self.entries.shape[1]) * 2), 1)

    def _block(self, width: int) -> int:
        """Vectors whose differences with ``width`` entries are held at a time."""
        return max(BLOCK // (width * self.entries.shape[1]), 1)

    def _candidates(self, cells: np.ndarray) -> list[np.ndarray]:
        low = cells[:, None] * self.side
        high = low + self.side - 1
        below, above = low - self.entries[None], self.entries[None] - high
        least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=2)
        greatest = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(axis=2)
        may_win = least <= greatest.min(axis=1, keepdims=True)
        return [np.flatnonzero(row) for row in may_win]

    def _look_up(self, cells: np.ndarray) -> list[np.ndarray]:
        keys = [cell.tobytes() for cell in cells]
        if len(self.known) + len(keys) > self.cells:
            self.known.clear()
        missing = [i for i, key in enumerate(keys) if key not in self.known]
        step = self._block(len(self.entries))
        for at in range(0, len(missing), step):
            some = missing[at : at + step]
            self.known.update(zip((keys[i] for i in some), self._candidates(cells[some])))
        return [self.known[key] for key in keys]

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each vector, and the squared distance to it."""
        places, errors = np.zeros(len(vectors), np.int64), np.zeros(len(vectors), np.int64)
        if not len(vectors) or not vectors.shape[1]:
            return places, errors
        grid = vectors // self.side
        first, cell_of = _distinct(grid)
        found = self._look_up(grid[first])
        sizes = np.array([len(f) for f in found])
        table = np.zeros((len(found), sizes.max()), np.int64)
        for row, f in zip(table, found):
            # Behind the last candidate comes the last one again, which wins no tie against itself.
            row[: len(f)], row[len(f) :] = f, f[-1]
        order = np.argsort(sizes[cell_of], kind="stable")
        step = self._block(sizes.max())
        for at in range(0, len(order), step):
            rows = order[at : at + step]
            width = sizes[cell_of[rows[-1]]]
            tried = table[cell_of[rows], :width]
            apart = ((vectors[rows, None] - self.entries[tried]) ** 2).sum(axis=2)
            best = apart.argmin(axis=1)
            each = np.arange(len(rows))
            places[rows], errors[rows] = tried[each, best], apart[each, best]
            self.evaluated += int(sizes[cell_of[rows]].sum())
        return places, errors


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of one row of each kind, and the kind of each row; dimension by dimension, so numbers stay small."""
    kind = np.zeros(len(rows), np.int64)
    first = np.zeros(1, np.int64)
    for column in rows.T:
        values, of = np.unique(column, return_inverse=True)
        _, first, kind = np.unique(kind * len(values) + of, return_index=True, return_inverse=True)
    return first, kind


class Codebooks:
    """One codebook per part; ``books`` has the shape (parts, entries, width of a part)."""

    def __init__(self, books: np.ndarray):
        self.books = books
        self.nearest = [NearestEntry(book) for book in books]

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices and squared distances, a column per part."""
        parts, _, width = self.books.shape
        each = [self.nearest[p].assign(vectors[:, p * width : (p + 1) * width]) for p in range(parts)]
        return np.stack([e[0] for e in each], axis=1), np.stack([e[1] for e in each], axis=1)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(np.int64) if len(column) else np.zeros((0, 0), np.int64)


def _sums(rows: DataFrame, books: np.ndarray) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Count and componentwise sum of the vectors' parts per part and entry; summed in each task before anything moves."""
    parts, entries, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Codebooks(books)
        counts = np.zeros((parts, entries), np.int64)
        totals = np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            vectors = _matrix(batch.column("q"))
            if not len(vectors):
                continue
            places, _ = coder.assign(vectors)
            for p in range(parts):
                counts[p] += np.bincount(places[:, p], minlength=entries)
                np.add.at(totals[p], places[:, p], vectors[:, p * width : (p + 1) * width])
        p, e = np.nonzero(counts)
        columns = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e], pa.int64())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(totals[p, e].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    found = rows.select("q").mapInArrow(add, "part int, entry int, n bigint, total array<bigint>")
    sums = [F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)]
    # At most a row per part and entry, whatever the number of vectors.
    found = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect()
    return {(r["part"], r["entry"]): (r["n"], [r[f"t{i}"] for i in range(width)]) for r in found}


def fit_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks of ``q`` vectors: the parts of the rows with the smallest ids, then ``rounds`` of floored means; None without rows."""
    start = rows.select("vec_id", "q").orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).collect()
    if not start:
        return None
    size = len(start[0]["q"])
    if size % parts or any(len(r["q"]) != size for r in start):
        raise ValueError(f"vectors must have the same number of components, a multiple of {parts}")
    books = np.array([r["q"] for r in start], np.int64).reshape(len(start), parts, size // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for (part, entry), (n, total) in _sums(rows, books).items():
            books[part, entry] = [t // n for t in total]
    return books


def _coded(q: Column, books: np.ndarray) -> Column:
    @F.arrow_udf("struct<code:array<int>,error:bigint>")
    def code(vectors: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = Codebooks(books)
        for batch in vectors:
            places, errors = coder.assign(_matrix(batch)) if len(batch) else (np.zeros((0, len(books)), np.int64),) * 2
            ends = pa.array(np.arange(len(places) + 1) * len(books), pa.int32())
            codes = pa.ListArray.from_arrays(ends, pa.array(places.ravel(), pa.int32()))
            yield pa.StructArray.from_arrays([codes, pa.array(errors.sum(axis=1), pa.int64())], names=["code", "error"])

    return code(q)


def compress_vectors(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, np.ndarray | None]:
    """``vec_id, code, error, label_error`` and the codebooks, an array of shape (parts, entries, width of a part).

    Components are floored 256ths. Vectors are cut into equal consecutive parts, each of which is coded by the nearest entry of
    the codebook of its place (squared distance, ties to the lower index). ``code`` is the indices in part order, ``error`` the sum of
    the distances, ``label_error`` the sum of ``error`` over all rows of the same label, nulls together.

    Left out are null vectors, empty ones, and those with a null or non-finite component. The other ones must have the same number of
    components, a multiple of ``parts``, each below 65,536 in size, or an error says so. The codebooks start from the ``entries``
    smallest ids; null ids come last, rows of equal ids in the order of their components. With fewer vectors there are fewer entries,
    and an empty table gives no rows and no codebooks. Repeated rows are coded each, null keys stay, other columns are left out.

    Codebooks and their sums are the only things that reach the driver; both have the size of the codebooks.
    """
    scaled = F.transform(col(vector), lambda x: F.floor(x.cast("double") * SCALE))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    small = F.forall("q", lambda x: F.abs(x) < LARGEST)
    kept = vectors.where(F.coalesce(F.size(col(vector)) > 0, F.lit(False)) & F.forall(col(vector), number))
    kept = kept.select(col(key).alias("vec_id"), col(label).alias("label"), scaled.alias("q"))
    told = F.when(small, F.col("q")).otherwise(F.raise_error(F.lit("components must be below 65,536 in size")).cast("array<bigint>"))
    rows = materialise(kept.select("vec_id", "label", told.cast("array<int>").alias("q")))
    books = fit_codebooks(rows, parts, entries, rounds)
    if books is None:
        return rows.selectExpr("vec_id", "array(0) as code", "0L as error", "0L as label_error"), None
    size = books.shape[0] * books.shape[2]
    even = F.when(F.size("q") == size, F.col("q")).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("array<int>"))
    # A label may hold most rows, so each is dealt out over as many groups as there are tasks and its sum goes to all of these.
    salt = F.pmod(F.xxhash64("vec_id", "q"), F.lit(partitions(rows.sparkSession)).cast("bigint")).cast("int")
    coded = materialise(rows.select("vec_id", "label", salt.alias("salt"), _coded(even, books).alias("c")).select("vec_id", "label", "salt", "c.*"))
    sums = coded.groupBy("label", "salt").agg(F.sum("error").alias("error"))
    sums = sums.groupBy("label").agg(F.sum("error").alias("label_error"), F.collect_list("salt").alias("salts"))
    sums = sums.select(F.col("label").alias("of"), "label_error", F.explode("salts").alias("of_salt"))
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("of_salt")))
    return joined.select("vec_id", "code", "error", "label_error"), books
