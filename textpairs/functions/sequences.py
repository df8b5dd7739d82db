"""Token-id sequences as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textpairs.schema import PAD_ID, SEP_ID, START_ID


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _ids(*values: int) -> Column:
    return F.array(*[F.lit(v).cast("int") for v in values])


def assemble_pair(premise: Column | str, hypothesis: Column | str, max_length: int | None = None) -> Column:
    """``[start] + premise + [sep] + hypothesis + [sep]``, the body cut first when ``max_length`` is given."""
    body = F.concat(_col(premise), _ids(SEP_ID), _col(hypothesis))
    if max_length is not None:
        body = truncate_tail(body, max_length)
    return F.concat(_ids(START_ID), body, _ids(SEP_ID))


def truncate_tail(body: Column | str, max_length: int = 512) -> Column:
    """Cut the body so that it fits ``max_length`` once the two outer specials are added."""
    return F.slice(_col(body), 1, max_length - 2)


def truncate_longest_first(
    premise: Column | str, hypothesis: Column | str, max_length: int = 256
) -> tuple[Column, Column]:
    """Cut the longer side until both fit beside three specials; a tie cuts the hypothesis.

    The outcome of cutting one token at a time is known in closed form: neither side goes below
    its half of the budget unless it is shorter than that anyway.
    """
    premise, hypothesis = _col(premise), _col(hypothesis)
    budget = max_length - 3
    upper, lower = (budget + 1) // 2, budget // 2
    p, h = F.size(premise), F.size(hypothesis)
    keep_p = F.least(p, F.greatest(F.lit(upper), F.lit(budget) - h))
    keep_h = F.least(h, F.greatest(F.lit(lower), F.lit(budget) - p))
    return F.slice(premise, F.lit(1), keep_p), F.slice(hypothesis, F.lit(1), keep_h)


def attention_mask(ids: Column | str) -> Column:
    return F.transform(_col(ids), lambda x: (x != PAD_ID).cast("int"))


def token_type_ids(premise: Column | str, hypothesis: Column | str) -> Column:
    """0 for the start, premise and first separator; 1 for the hypothesis and last separator."""
    return F.concat(
        F.array_repeat(F.lit(0), F.size(_col(premise)) + 2),
        F.array_repeat(F.lit(1), F.size(_col(hypothesis)) + 1),
    )


def segment_ids(ids: Column | str) -> Column:
    """Segments of an assembled, cut or padded id array, as long as it: 1 after the first separator, else and on padding 0."""
    ids = _col(ids)
    middle = first_separator(ids)
    return F.transform(ids, lambda x, i: ((i > middle) & (x != PAD_ID)).cast("int"))


def pad_to(ids: Column | str, length: Column | int, fill: int = PAD_ID) -> Column:
    """Append ``fill`` up to ``length``; ids already that long stay as they are."""
    ids = _col(ids)
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(ids, F.array_repeat(F.lit(fill).cast("int"), F.greatest(length - F.size(ids), F.lit(0))))


def pad_fixed(ids: Column | str, max_len: int, fill: int = PAD_ID) -> Column:
    """Pad to ``max_len``; a longer sequence is an error."""
    ids = _col(ids)
    too_long = F.raise_error(F.lit(f"sequence longer than {max_len}")).cast("array<int>")
    return F.when(F.size(ids) > max_len, too_long).otherwise(pad_to(ids, max_len, fill))


def first_separator(ids: Column | str) -> Column:
    """0-based position of the first separator."""
    return (F.array_position(_col(ids), F.lit(SEP_ID)) - 1).cast("int")


def valid_span_count(premise: Column | str, hypothesis: Column | str) -> Column:
    """Number of spans inside either text of an untruncated pair."""
    p, h = F.size(_col(premise)).cast("bigint"), F.size(_col(hypothesis)).cast("bigint")
    return (p * (p + 1) / 2 + h * (h + 1) / 2).cast("bigint")


def span_mask(start: Column | str, end: Column | str, length: Column | str, middle: Column | str) -> Column:
    """0 for a span inside one text of the row, 1e6 for one on specials, padding, or across texts."""
    start, end, length, middle = _col(start), _col(end), _col(length), _col(middle)
    inside = (start >= 1) & (start <= length - 2) & (end >= 1) & (end <= length - 2)
    one_side = (start > middle) | (end < middle)
    return F.when(inside & one_side, F.lit(0)).otherwise(F.lit(1_000_000))
