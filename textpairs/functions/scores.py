"""Class-score arithmetic on small fixed-width arrays.

Expressions are unrolled over ``classes`` so that they stay inside generated code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CLASSES = 3


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _items(arr: Column | str, classes: int) -> list[Column]:
    arr = _col(arr)
    return [arr[i].cast("double") for i in range(classes)]


def _total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def softmax(arr: Column | str, classes: int = CLASSES) -> Column:
    items = _items(arr, classes)
    top = F.greatest(*items)
    exps = [F.exp(x - top) for x in items]
    total = _total(exps)
    return F.array(*[e / total for e in exps])


def argmax(arr: Column | str) -> Column:
    """0-based position of the first maximum."""
    arr = _col(arr)
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def log_sum_exp(arr: Column | str, classes: int = CLASSES) -> Column:
    items = _items(arr, classes)
    top = F.greatest(*items)
    return top + F.log(_total([F.exp(x - top) for x in items]))


def negative_log_likelihood(arr: Column | str, label: Column | str, classes: int = CLASSES) -> Column:
    """``-log softmax(arr)[label]``; a label outside the classes is an error."""
    return log_sum_exp(arr, classes) - _col(arr)[_col(label)].cast("double")


def smoothed_nll(arr: Column | str, label: Column | str, eps: float = 0.2, classes: int = CLASSES) -> Column:
    """``(1 - eps) * nll + eps * mean over classes of -log p``."""
    uniform = log_sum_exp(arr, classes) - _total(_items(arr, classes)) / classes
    return (1.0 - eps) * negative_log_likelihood(arr, label, classes) + eps * uniform
