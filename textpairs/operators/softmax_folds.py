"""Softmax regressions of all folds at the same time: every step of their optimisers is one pass over shared rows."""

from __future__ import annotations

import math
import pickle
from collections.abc import Generator, Iterator, Sequence
from functools import partial
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, Broadcast, StorageLevel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.sql import DataFrame, Row

PARTS_PER_CORE, BLOCKS_PER_PART = 2, 4
BLOCK_ENTRIES = 1 << 16, 1 << 20
PIECE_ENTRIES = 1 << 16
CORRECTIONS, VALUES, SEARCH_STEPS = 10, 20, 10  # fixed values: those of Spark's optimiser
DECREASE, CURVATURE = 1e-4, 0.9


class Point(NamedTuple):
    """What is known of the objective at ``x``; ``t`` and ``slope`` are those along a search direction."""

    x: np.ndarray
    value: float
    grad: np.ndarray
    t: float = 0.0
    slope: float = 0.0


Search = Generator[np.ndarray, tuple[float, np.ndarray], Point]


class SearchFailed(Exception):
    pass


def _between(a: Point, b: Point) -> float:
    """Least place of the cubic through two points, kept off both ends."""
    low, high = (b, a) if a.t > b.t else (a, b)
    with np.errstate(all="ignore"):
        d1 = low.slope + high.slope - 3 * np.float64(low.value - high.value) / (low.t - high.t)
        d2 = np.sqrt(d1 * d1 - low.slope * high.slope)
        t = high.t - (high.t - low.t) * (high.slope + d2 - d1) / (high.slope - low.slope + 2 * d2)
    if math.isnan(t):
        raise SearchFailed
    return float(min(max(t, low.t + 0.1 * (high.t - low.t)), low.t + 0.9 * (high.t - low.t)))


def _line_search(start: Point, direction: np.ndarray, t: float) -> Search:
    """A point along ``direction`` that meets the strong Wolfe conditions."""
    start = start._replace(t=0.0, slope=float(start.grad @ direction))
    if start.slope > 0:
        raise SearchFailed

    def at(t: float) -> Search:
        x = start.x + direction * t
        value, grad = yield x
        return Point(x, value, grad, t, float(grad @ direction))

    def zoom(low: Point, high: Point) -> Search:
        for _ in range(SEARCH_STEPS):
            c = yield from at(_between(low, high))
            if c.value > start.value + DECREASE * c.t * start.slope or c.value >= low.value:
                high = c
                continue
            if abs(c.slope) <= CURVATURE * abs(start.slope):
                return c
            if c.slope * (high.t - low.t) >= 0:
                high = low
            low = c
        raise SearchFailed

    low = start
    for i in range(SEARCH_STEPS):
        c = yield from at(t)
        if not math.isfinite(c.value):
            t /= 2
            continue
        if c.value > start.value + DECREASE * t * start.slope or (c.value >= low.value and i > 0):
            return (yield from zoom(low, c))
        if abs(c.slope) <= CURVATURE * abs(start.slope):
            return c
        if c.slope >= 0:
            return (yield from zoom(c, low))
        low, t = c, t * 1.5
    raise SearchFailed


def _descent(grad: np.ndarray, history: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out, scale, used = grad.copy(), 1.0, []
    with np.errstate(all="ignore"):
        if history:
            step, change = history[0]
            along = step @ change
            if not along >= 0:
                raise SearchFailed
            scale = along / (change @ change)
        for step, change in history:
            along = step @ change
            a = (step @ out) / along
            if math.isnan(a):
                raise SearchFailed
            out -= a * change
            used.append((a, along))
        out *= scale
        for (step, change), (a, along) in zip(reversed(history), reversed(used)):
            out += (a - (change @ out) / along) * step
    return -out


def lbfgs(x: np.ndarray, max_iter: int, tol: float) -> Generator[np.ndarray, tuple[float, np.ndarray], tuple[np.ndarray, list[float]]]:
    """The steps of Spark's L-BFGS (Breeze): yields points, is sent their value and gradient, returns the last point
    and the values on the way."""
    value, grad = yield x
    now, iteration, failed, history = Point(x, value, grad), 0, False, []
    first, recent, values = abs(value), [math.inf], [value]
    while not (
        iteration >= max_iter
        or (len(recent) > 1 and abs(now.value - max(recent)) <= tol * first)
        or np.linalg.norm(now.grad) <= max(tol * abs(now.value), 1e-8)
    ):
        try:
            direction = _descent(now.grad, history)
            found = yield from _line_search(now, direction, 1.0 if iteration else 1.0 / float(np.linalg.norm(direction)))
            if found.t * np.linalg.norm(now.grad) < 1e-10:
                raise SearchFailed
        except SearchFailed:
            values.append(now.value)
            if failed:
                break
            failed, history = True, []
            continue
        history = [(found.x - now.x, found.grad - now.grad), *history][:CORRECTIONS]
        now, iteration, failed = found, iteration + 1, False
        recent = [*recent, now.value][-VALUES:]
        values.append(now.value)
    return now.x, values


class Part(NamedTuple):
    """Entries of some rows, once in the order of the rows and once in that of the features.

    Row ``rows[i]`` has the next ``row_sizes[i]`` of ``indices``, feature ``features[i]`` the next ``feature_sizes[i]`` of
    ``owners``. The values come in either order; without them all are 1.
    """

    rows: np.ndarray
    row_sizes: np.ndarray
    indices: np.ndarray
    features: np.ndarray
    feature_sizes: np.ndarray
    owners: np.ndarray
    row_values: np.ndarray | None
    feature_values: np.ndarray | None


def _short(places: np.ndarray) -> np.ndarray:
    return places.astype("u2" if len(places) == 0 or places.max() < 1 << 16 else "i4")


def _narrow(values: np.ndarray) -> np.ndarray:
    """The same numbers in as few bytes as hold them exactly."""
    with np.errstate(all="ignore"):
        return next((v for kind in ("u1", "f4") if np.array_equal(v := values.astype(kind), values)), values)


def _part(owners: np.ndarray, indices: np.ndarray, values: np.ndarray | None) -> Part:
    """``owners`` ascend."""
    owners, indices = _short(owners), _short(indices)
    order = np.argsort(indices, kind="stable")
    at = [np.flatnonzero(np.diff(x, prepend=-1)) for x in (owners.astype("i4"), indices[order].astype("i4"))]
    sizes = [_short(np.diff(starts, append=len(owners))) for starts in at]
    given = (None, None) if values is None else (_narrow(values), _narrow(values[order]))
    return Part(owners[at[0]], sizes[0], indices, indices[order][at[1]], sizes[1], owners[order], *given)


def _block(fold: int, labels: np.ndarray, sizes: np.ndarray, indices: np.ndarray, values: np.ndarray) -> bytes:
    """Rows of one fold: the fold, labels, parts. Counts are mostly 1, and those entries need no product."""
    owners, other = np.repeat(np.arange(len(sizes)), sizes), values != 1.0
    parts = [_part(owners[~other], indices[~other], None), _part(owners[other], indices[other], values[other])]
    return pickle.dumps((fold, labels.astype("i4"), [tuple(p) for p in parts if len(p.indices)]), protocol=5)


def _entries(vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of each row, their features and values, of dense and sparse vectors."""
    if vectors.null_count:
        raise ValueError("a row has no features")
    values = vectors.field("values")
    ends = np.cumsum(sizes := np.diff(values.offsets.to_numpy()).astype(np.int64))
    flat = values.flatten().to_numpy(zero_copy_only=False)
    if not np.isfinite(flat).all():
        raise ValueError("features must not be NaN or infinite")
    place = np.arange(len(flat)) - np.repeat(ends - sizes, sizes)
    sparse = np.repeat(vectors.field("type").to_numpy(zero_copy_only=False) == 0, sizes)
    place[sparse] = vectors.field("indices").flatten().to_numpy(zero_copy_only=False)
    return sizes, place, flat


def _packed(entries: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of at least so many ``entries``, but for the last one of a fold."""
    held: dict[int, list[tuple[np.ndarray, ...]]] = {}

    def taken(fold: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"block": [_block(fold, *(np.concatenate(x) for x in zip(*held.pop(fold))))]})

    for batch in batches:
        labels, folds = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        sizes, indices, values = _entries(batch.column(2))
        of_entry = np.repeat(folds, sizes)
        for fold in np.unique(folds).tolist():
            rows, own = folds == fold, of_entry == fold
            held.setdefault(fold, []).append((labels[rows], sizes[rows], indices[own], values[own]))
            if sum(len(x[2]) for x in held[fold]) >= entries:
                yield taken(fold)
    for fold in list(held):
        yield taken(fold)


def _dealt(tasks: int, task: int, blocks: Iterator[Row]) -> Iterator[tuple[int, bytes]]:
    for i, block in enumerate(blocks):
        yield i * tasks + task, bytes(block[0])


def packed_rows(df: DataFrame, features: str, entries: int) -> RDD:
    """The rows of ``df`` (``label``, ``fold``, a vector column with so many ``entries``) as pickled blocks of one fold each.

    Executors keep them, dealt to parts as equal as the blocks allow.
    """
    parts = PARTS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    size = min(max(entries // (parts * BLOCKS_PER_PART), BLOCK_ENTRIES[0]), BLOCK_ENTRIES[1])
    parts = min(max(entries // size, 1), parts)
    wanted = df.where("fold is not null").select("label", "fold", features)
    packed = wanted.mapInArrow(partial(_packed, size), "block binary").rdd
    dealt = packed.mapPartitionsWithIndex(partial(_dealt, packed.getNumPartitions())).partitionBy(parts, int)
    return dealt.values().persist(StorageLevel.MEMORY_AND_DISK)


def _pieces(sizes: np.ndarray) -> list[tuple[slice, slice, np.ndarray]]:
    """Runs of about ``PIECE_ENTRIES`` entries: which groups, which entries, where the groups start in them."""
    ends = np.cumsum(sizes, dtype=np.intp)
    cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(PIECE_ENTRIES, ends[-1], PIECE_ENTRIES)) + 1, len(ends)])
    starts = ends - sizes
    return [(slice(a, b), slice(starts[a], ends[b - 1]), starts[a:b] - starts[a]) for a, b in zip(cuts[:-1], cuts[1:])]


def _group_sums(groups: np.ndarray, sizes: np.ndarray, places: np.ndarray, values: np.ndarray | None, sources: list, sums: list) -> None:
    """Adds to ``sums``, at each group, what ``sources`` have at its places, times the values."""
    for some, entries, starts in _pieces(sizes):
        at, to = places[entries].astype(np.intp), groups[some]
        held = np.empty(len(at), np.complex128)
        for source, total in zip(sources, sums):
            source.take(at, out=held, mode="clip")  # "raise" would take a copy
            if values is not None:
                np.multiply(held, values[entries], out=held)
            total[to] += np.add.reduceat(held, starts)


def _errors(margins: np.ndarray, at: tuple[np.ndarray, np.ndarray]) -> tuple[float, np.ndarray]:
    """Loss of margins (class, row) and probabilities less the true class, both over the rows."""
    margins = margins - margins.max(axis=0)
    loss = -margins[at].sum()
    errors = np.exp(margins, out=margins)
    total = errors.sum(axis=0)
    errors /= total
    errors[at] -= 1.0
    return loss + np.log(total).sum(), errors


def _pairs(columns: np.ndarray) -> np.ndarray:
    """Two columns as the parts of one complex column: they are looked up and added together."""
    out = np.zeros((ceil(len(columns) / 2), columns.shape[1]), np.complex128)
    out.real, out.imag[: len(columns) // 2] = columns[::2], columns[1::2]
    return out


def _apart(pairs: np.ndarray, n: int) -> np.ndarray:
    return np.stack([pairs.real, pairs.imag], axis=1).reshape(-1, pairs.shape[1])[:n]


def _pass(sent: Broadcast, blocks: Iterator[bytes]) -> Iterator[np.ndarray]:
    """Over the blocks of a task: per run the loss, the sums of the errors and the gradient, one after the other.

    The last class has weights of 0, and the sums of its errors are what those of the others lack to 0.
    """
    names, weights, offsets = sent.value
    classes, sources = offsets.shape[1], [_pairs(w) for w in weights]
    loss, errors, grads = np.zeros(len(names)), np.zeros_like(offsets), [np.zeros_like(x) for x in sources]
    for fold, labels, parts in map(pickle.loads, blocks):
        parts = [Part(*p) for p in parts]
        runs, at = [i for i, name in enumerate(names) if name != fold], (labels, np.arange(len(labels)))
        margins = {i: np.zeros((len(sources[i]), len(labels)), np.complex128) for i in runs}
        for p in parts:
            _group_sums(p.rows, p.row_sizes, p.indices, p.row_values, *([x for i in runs for x in y[i]] for y in (sources, margins)))
        wrong = {}
        for i in runs:
            own = np.vstack([_apart(margins[i], classes) + offsets[i][:, None], np.zeros(len(labels))])
            lost, found = _errors(own, at)
            loss[i] += lost
            errors[i] += found[:-1].sum(axis=1)
            wrong[i] = _pairs(found[:-1])
        for p in parts:
            _group_sums(p.features, p.feature_sizes, p.owners, p.feature_values, *([x for i in runs for x in y[i]] for y in (wrong, grads)))
    yield np.concatenate([loss, errors.ravel(), *(_apart(g, classes).ravel() for g in grads)])


class Run(NamedTuple):
    """Training part of a fold: rows per class, mean and deviation of its features as they are, their weights."""

    labels: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray


def fits_jointly(estimator: object) -> bool:
    """Whether ``fit_jointly`` does what this estimator does."""
    if type(estimator) is not LogisticRegression:
        return False
    bounds = ("lowerBoundsOnCoefficients", "upperBoundsOnCoefficients", "lowerBoundsOnIntercepts", "upperBoundsOnIntercepts")
    plain = not any(estimator.isSet(p) for p in ("weightCol", *bounds))
    usual = estimator.getFitIntercept() and estimator.getStandardization() and estimator.getElasticNetParam() == 0
    return plain and usual and estimator.getRegParam() > 0 and estimator.getFamily() in ("auto", "multinomial")


class Fitted(NamedTuple):
    coefficients: np.ndarray
    intercepts: np.ndarray
    values: list[float]


class _Space:
    """Points of an optimiser for a run: coefficients of its scaled, centred features and intercepts.

    Over the classes both add up to 0 at the start and so at every step; coordinates in that plane, one less than there
    are classes, have the same lengths and angles. Features without a deviation or weight have no coordinates.
    """

    def __init__(self, run: Run, reg: float) -> None:
        self.run, self.reg, self.n, classes = run, reg, run.labels.sum(), len(run.labels)
        self.plane = np.linalg.qr(np.hstack([np.ones((classes, 1)), np.eye(classes)[:, :-1]]))[0][:, 1:]
        self.used = np.flatnonzero((run.deviation != 0) & (run.weights != 0))
        self.scale = 1.0 / run.deviation[self.used]
        self.centre = self.scale * run.mean[self.used]

    def start(self) -> np.ndarray:
        x = np.zeros((len(self.used) + 1) * self.plane.shape[1])
        x[-self.plane.shape[1] :] = self.plane.T @ np.log1p(self.run.labels)
        return x

    def model(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients of the used features as they are, and intercepts."""
        own = self.plane.shape[1]
        w = self.plane @ x[:-own].reshape(own, -1)
        return w * self.scale, self.plane @ x[-own:] - w @ self.centre

    def sent(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The model less its last class."""
        w, b = self.model(x)
        out = np.zeros((len(b) - 1, len(self.run.mean)))
        out[:, self.used] = w[:-1] - w[-1]
        return out, b[:-1] - b[-1]

    def objective(self, x: np.ndarray, loss: float, errors: np.ndarray, grad: np.ndarray) -> tuple[float, np.ndarray]:
        """Value and gradient at ``x`` from the sums over the rows, those of the last class left out."""
        errors, grad = np.append(errors, -errors.sum()), grad[:, self.used]
        grad = np.vstack([grad, -grad.sum(axis=0)]) * self.scale - np.outer(errors, self.centre)
        w = x[: -self.plane.shape[1]]
        slope = (self.plane.T @ grad).ravel() / self.n + self.reg * w
        return loss / self.n + self.reg * float(w @ w) / 2, np.concatenate([slope, self.plane.T @ errors / self.n])

    def fitted(self, x: np.ndarray, values: list[float]) -> Fitted:
        w, b = self.model(x)
        out = np.zeros((len(b), len(self.run.mean)))
        out[:, self.used] = w / self.run.weights[self.used]
        return Fitted(out, b - b.mean(), values)


def fit_jointly(blocks: RDD, estimator: LogisticRegression, runs: dict[int, Run]) -> dict[int, Fitted]:
    """For each run the regression that ``estimator`` fits to the rows outside its fold, features times their weights.

    Each fit takes the steps that Spark's own would take. Features are scaled and centred through the coefficients, so
    all runs read the same rows; a step of all of them is one pass, in which a row meets every run that trains on it.
    """
    sc = blocks.context
    spaces = {name: _Space(run, estimator.getRegParam()) for name, run in runs.items()}
    fits = {name: lbfgs(space.start(), estimator.getMaxIter(), estimator.getTol()) for name, space in spaces.items()}
    asked, done = {name: next(fit) for name, fit in fits.items()}, {}
    while asked:
        names = list(asked)
        weights, offsets = (np.stack(x) for x in zip(*(spaces[name].sent(x) for name, x in asked.items())))
        sent = sc.broadcast((names, weights, offsets))
        found = blocks.mapPartitions(partial(_pass, sent)).treeReduce(np.add, estimator.getAggregationDepth())
        sent.destroy()
        loss, errors, grads = np.split(found, np.cumsum([len(names), offsets.size]))
        errors, grads = errors.reshape(offsets.shape), grads.reshape(weights.shape)
        for i, name in enumerate(names):
            try:
                asked[name] = fits[name].send(spaces[name].objective(asked[name], loss[i], errors[i], grads[i]))
            except StopIteration as end:
                del asked[name]
                done[name] = spaces[name].fitted(*end.value)
    return done


def as_model(estimator: LogisticRegression, fitted: Fitted, train: DataFrame) -> LogisticRegressionModel:
    """Spark's model with these coefficients; its summary describes ``train``."""
    sc = train.sparkSession.sparkContext
    classes, features = fitted.coefficients.shape
    matrix = DenseMatrix(classes, features, fitted.coefficients.ravel(), True)
    made = sc._jvm.org.apache.spark.ml.classification
    parent = estimator._to_java()
    coefficients, intercepts = _py2java(sc, matrix).compressed(), _py2java(sc, DenseVector(fitted.intercepts)).compressed()
    java = made.LogisticRegressionModel(parent.uid(), coefficients, intercepts, classes, True)
    java = parent.copyValues(java, sc._jvm.org.apache.spark.ml.param.ParamMap.empty()).setParent(parent)
    model = estimator._copyValues(LogisticRegressionModel(java))
    values = sc._gateway.new_array(sc._jvm.double, len(fitted.values))
    for i, v in enumerate(fitted.values):
        values[i] = float(v)
    java.createSummary(train._jdf, values)
    return model
