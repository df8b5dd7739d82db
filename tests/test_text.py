import random

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from helpers import one
from textpairs.functions import text
from textpairs.functions.labels import decode_label, encode_label

BAD1, GOOD1 = text.KNOWN_TYPOS[0]
BAD2, GOOD2 = text.KNOWN_TYPOS[1]


def restated(s):
    for bad, good in text.KNOWN_TYPOS:
        if bad in s:
            s = good
    s = s.replace("\u00a0", "").replace("\u0008", "")
    for c in "《》『』…":
        s = s.replace(c, " ")
    return " ".join(s.replace("．", ".").split())


@pytest.mark.parametrize(
    "given, expected",
    [
        ("a\u00a0b", "ab"),
        ("a\u0008b", "ab"),
        ("《가》나", "가 나"),
        ("가…나", "가 나"),
        ("가．", "가."),
        ("  a\t\nb\u3000c ", "a b c"),
        ("\u00a0", ""),
        ("", ""),
        ("x" + BAD1 + "y", GOOD1),
        (BAD2, GOOD2),
        (BAD1 + BAD2, GOOD1),
    ],
)
def test_clean_text(spark, given, expected):
    assert one(spark, text.clean_text("t"), t=given) == expected == restated(given)


def test_clean_text_matches_the_rules_on_random_strings(spark):
    rng = random.Random(1)
    alphabet = [chr(c) for c in range(0x08, 0x0E)] + [chr(c) for c in range(0x1C, 0x21)]
    alphabet += [chr(c) for c in range(0x2000, 0x200C)] + list("\u0085\u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff")
    alphabet += list("ab가.《》『』…．   ")
    given = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(2000)]
    df = spark.createDataFrame([(s,) for s in given], "t string").select("t", text.clean_text("t").alias("c"))
    assert [(r.t, r.c) for r in df.collect() if r.c != restated(r.t)] == []


def test_every_blank_code_point(spark):
    chars = [chr(c) for c in range(1, 0x3100)]
    got = spark.createDataFrame([(c,) for c in chars], "c string").select(
        "c", text.squeeze_space(F.concat(F.lit("a"), "c", F.lit("b"))).alias("s")
    )
    assert [r.c for r in got.collect() if (r.s == "a b") != c_is_blank(r.c)] == []


def c_is_blank(c):
    return len(f"a{c}b".split()) == 2


def test_cleaning_twice_changes_nothing(spark):
    once = text.clean_text("t")
    assert one(spark, text.clean_text(once) == once, t="\u00a0 a\t《b》 \u2003…c．")


def test_later_rule_sees_the_earlier_result(spark):
    rules = [("a", "xb"), ("b", "c")]
    assert one(spark, text.fix_known_typos("t", rules), t="za") == "c"
    assert one(spark, text.fix_known_typos("t", rules), t="zb") == "c"
    assert one(spark, text.fix_known_typos("t", rules), t="z") == "z"


def test_labels(spark):
    for name, code in (("contradiction", 0), ("entailment", 1), ("neutral", 2)):
        assert one(spark, encode_label("t"), t=name) == code
        assert one(spark, decode_label("t"), t=code) == name
    with pytest.raises(SparkRuntimeException, match="unknown label"):
        one(spark, encode_label("t"), t="other")
    with pytest.raises(SparkRuntimeException, match="unknown label"):
        one(spark, decode_label("t"), t=3)
    assert one(spark, encode_label("t"), t=None) is None
    with pytest.raises(SparkRuntimeException, match="unknown label"):
        one(spark, encode_label("t", null_is_error=True), t=None)


def test_join_pair_text(spark):
    assert one(spark, text.join_pair_text("p", "h"), p="a", h="b") == "a[SEP]b"
    assert one(spark, text.join_pair_text("p", "h", strict=False), p="a", h=None) is None
    with pytest.raises(SparkRuntimeException, match="missing"):
        one(spark, text.join_pair_text("p", "h"), p="a", h=None)


def test_empty_results(spark):
    got = [one(spark, text.is_empty_result("t"), t=t) for t in ("", " ", "  ", "a")]
    assert got == [True, True, False, False]


def test_words(spark):
    assert one(spark, text.words("t"), t=" A\ta  b ") == ["A", "a", "b"]
    assert one(spark, text.words("t"), t=" \t") == []
