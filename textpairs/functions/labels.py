"""Label codes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from textpairs.schema import ID_TO_LABEL, LABEL_TO_ID


def _lookup(col: Column | str, mapping: dict, value_type: str, null_is_error: bool) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    unknown = F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(col.cast("string"), F.lit("null"))))
    # try_element_at gives null for an unknown key, which is an error here, never a null label.
    found = F.coalesce(F.try_element_at(table, col), unknown.cast(value_type))
    # Spark may test this expression for null before other filters, so a null label has to pass.
    return found if null_is_error else F.when(col.isNotNull(), found)


def encode_label(col: Column | str, null_is_error: bool = False) -> Column:
    """contradiction / entailment / neutral to 0 / 1 / 2; any other label raises, a null stays null."""
    return _lookup(col, LABEL_TO_ID, "int", null_is_error)


def decode_label(col: Column | str, null_is_error: bool = False) -> Column:
    """0 / 1 / 2 to the label name; any other code, the unlabelled sentinel included, raises."""
    return _lookup(col, ID_TO_LABEL, "string", null_is_error)
