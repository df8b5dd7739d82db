"""Column contract and constants shared by every operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Label codes.
LABEL_TO_ID = {"contradiction": 0, "entailment": 1, "neutral": 2}
ID_TO_LABEL = {code: name for name, code in LABEL_TO_ID.items()}
UNLABELLED = 3

# Reserved token ids.
START_ID, PAD_ID, SEP_ID, UNKNOWN_ID, MASK_ID = 0, 1, 2, 3, 4
FIRST_TOKEN_ID = 5

PAIR_SCHEMA = T.StructType(
    [
        T.StructField("index", T.LongType()),
        T.StructField("premise", T.StringType()),
        T.StructField("hypothesis", T.StringType()),
        T.StructField("label", T.StringType()),
    ]
)


def check_columns(df: DataFrame, schema: T.StructType = PAIR_SCHEMA, ignore_types: bool = False) -> DataFrame:
    """Return ``df`` unchanged if it holds every column of ``schema``; a schema check only, no job."""
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in schema.fields if f.name not in have]
    if missing:
        raise ValueError(f"missing columns {missing}; found {list(have)}")
    if not ignore_types:
        wrong = [
            f"{f.name}: {have[f.name].simpleString()} instead of {f.dataType.simpleString()}"
            for f in schema.fields
            if have[f.name] != f.dataType
        ]
        if wrong:
            raise ValueError(f"wrong column types: {wrong}")
    return df
