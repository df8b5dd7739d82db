"""Texts that cleaning leaves alone are passed on in one pass, with the same results."""

import random
import sys

from pyspark.sql import functions as F

from textpairs.functions import text


def _all_steps(col):
    mapped = F.translate(text.fix_known_typos(col), text.SPACED + text.WIDE_STOP + text.DELETED, " " * len(text.SPACED) + ".")
    return text.squeeze_space(mapped)


def test_cleaning_is_that_of_all_steps(spark):
    draw = random.Random(4)
    marked = text.SPACED + text.WIDE_STOP + text.DELETED + "\t\n\r\x0b\x1c\x1f\x85     　﻿"
    texts = ["", " ", "a", "a b", "a  b", " a", "a ", "a\n", None, "x" + text.KNOWN_TYPOS[0][0] + "y", text.KNOWN_TYPOS[1][0]]
    texts += [a + m + b for m in marked for a in ("", "a", "a ", "한") for b in ("", "b", " b", "글 \U0001f600")]
    texts += ["".join(draw.choices("ab  é한漢" + marked, weights=[9, 9, 4, 4, 9, 9, 9] + [1] * len(marked), k=9)) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    wrong = df.where(~text.clean_text("t").eqNullSafe(_all_steps(F.col("t"))))
    assert wrong.collect() == []


def test_every_character_is_cleaned_as_by_all_steps(spark):
    points = spark.range(1, sys.maxunicode + 1).where("id < 55296 or id > 57343")
    char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    df = points.select("id", F.explode(F.array(char, F.concat(F.lit("a"), char, F.lit(" b")))).alias("t"))
    assert df.where(~text.clean_text("t").eqNullSafe(_all_steps(F.col("t")))).collect() == []


def test_long_texts(spark):
    df = spark.range(1).select(F.repeat(F.lit("word 단어 "), 200_000).alias("t")).select(F.concat("t", F.lit("x")).alias("t"))
    assert df.select(F.col("t").rlike(text.PLAIN_TEXT), text.clean_text("t") == F.col("t")).first() == (True, True)
