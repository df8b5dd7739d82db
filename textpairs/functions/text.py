"""Text cleaning and joining as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Known corrupt sentences and their corrections, applied in this order.
KNOWN_TYPOS = (
    (
        "다음 교육에는 더 많은 인원을 대상으로 교육을 실시할 옞ㅇ이다.",
        "다음 교육에는 더 많은 인원을 대상으로 교육을 실시할 예정이다.",
    ),
    (
        "신 씨 부부는 교통사고를 내서 많은 사상자를 발생시켰다.ㄷ.",
        "신 씨 부부는 교통사고를 내서 많은 사상자를 발생시켰다.",
    ),
)

# Characters deleted, replaced by a space, and the full-width stop.
DELETED = "\u00a0\u0008"
SPACED = "《》『』…"
WIDE_STOP = "．"

# The code points that end a word, without the plain space.
_BLANK = r"\t-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# A run of blanks that is not exactly one plain space, so ordinary text has few matches.
BLANK_RUN = f"[{_BLANK}][ {_BLANK}]*| [ {_BLANK}]+"

# Words of characters that cleaning leaves as they are, one plain space between them: most texts, told in one cheap pass.
_PLAIN = r"[!-~\x{a1}-\x{167f}\x{3010}-\x{d7ff}]"
PLAIN_TEXT = rf"\A(?:{_PLAIN}++(?: (?={_PLAIN}))?)*+\z"

PAIR_SEPARATOR = "[SEP]"


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def fix_known_typos(col: Column | str, rules: Sequence[tuple[str, str]] = KNOWN_TYPOS) -> Column:
    """Replace the whole value by the correction when it contains a known corrupt sentence.

    Rules apply in order, each to the result of the one before. A hit turns the value into a
    constant, so what the remaining rules make of it is known here and one flat CASE is enough.
    """
    col = _col(col)
    out = None
    for i, (bad, good) in enumerate(rules):
        for later_bad, later_good in rules[i + 1 :]:
            if later_bad in good:
                good = later_good
        out = (F if out is None else out).when(col.contains(bad), F.lit(good))
    return col if out is None else out.otherwise(col)


def delete_chars(col: Column | str) -> Column:
    return F.translate(_col(col), DELETED, "")


def chars_to_space(col: Column | str) -> Column:
    return F.translate(_col(col), SPACED, " " * len(SPACED))


def normalise_stop(col: Column | str) -> Column:
    return F.translate(_col(col), WIDE_STOP, ".")


def squeeze_space(col: Column | str) -> Column:
    """Every run of blanks becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(_col(col), BLANK_RUN, " "))


def clean_text(col: Column | str) -> Column:
    """Typos on the raw text, then deletions, replacements and the stop in one pass, then blanks.

    A text that none of these would change is passed on as it is.
    """
    col = _col(col)
    plain = col.rlike(PLAIN_TEXT)
    for bad, _ in KNOWN_TYPOS:
        plain = plain & ~col.contains(bad)
    mapped = F.translate(fix_known_typos(col), SPACED + WIDE_STOP + DELETED, " " * len(SPACED) + ".")
    return F.when(plain, col).otherwise(squeeze_space(mapped))


def join_pair_text(premise: Column | str, hypothesis: Column | str, strict: bool = True) -> Column:
    """``premise[SEP]hypothesis``; a missing side raises unless ``strict`` is off, which gives null."""
    joined = F.concat(_col(premise), F.lit(PAIR_SEPARATOR), _col(hypothesis))
    if not strict:
        return joined
    return F.coalesce(joined, F.raise_error(F.lit("premise or hypothesis is missing")).cast("string"))


def is_empty_result(col: Column | str) -> Column:
    return _col(col).isin("", " ")


def words(col: Column | str) -> Column:
    """Cleaned text split at single spaces, empty tokens dropped, case kept."""
    return F.filter(F.split(clean_text(col), " ", -1), lambda w: w != "")
