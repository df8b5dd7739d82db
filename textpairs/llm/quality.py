"""Quality rules whose cutoffs are certified on labelled documents to reject few good ones."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpairs.llm.common import col
from textpairs.storage import materialise

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
MEASURED = "struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# A rule rejects where 1000 * numerator > cutoff * denominator ("above") or < ("below"); cutoffs from lenient to strict.
RULES: dict[str, tuple[str, str, str, tuple[int, ...]]] = {
    "symbols": ("n_symbols", "n_words", "above", (1500, 1000, 700, 500, 300, 200, 100)),
    "repeats": ("n_repeat_words", "n_words", "above", (450, 400, 350, 300, 250, 200)),
    "dup_lines": ("n_dup_lines", "n_lines", "above", (700, 600, 500, 400, 300, 200)),
    "long_words": ("word_chars", "n_words", "above", (12000, 10000, 9000, 8000, 7000)),
    "short_words": ("word_chars", "n_words", "below", (2500, 3000, 3500, 4000, 4200)),
}
ALPHA = 0.05
DELTA = 0.05


def measure_text(text: str | None) -> tuple[int, ...]:
    """The measures of one text; null counts as empty."""
    text = text or ""
    found = text.encode().split()
    n = len(found)
    spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(" \t\x0b\x0c\r")]
    windows = list(zip(found, found[1:], found[2:], strict=False))
    repeated = 0
    if len(windows) > len(set(windows)):
        counts, end = Counter(windows), 0
        for i, window in enumerate(windows):
            if counts[window] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return n, len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def measured(text: Column) -> Column:
    """The measures of whole texts as one struct column."""

    @F.arrow_udf(MEASURED)
    def measure(texts: pa.Array) -> pa.Array:
        rows = [measure_text(t.as_py()) for t in texts]
        columns = zip(*rows, strict=True) if rows else [[] for _ in MEASURES]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(MEASURES))

    return measure(text)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _rejects(rule: str, cutoff: Column | int) -> Column:
    above, below, side, _ = RULES[rule]
    left, right = 1000 * F.col(above), (F.lit(cutoff) if isinstance(cutoff, int) else cutoff) * F.col(below)
    return left > right if side == "above" else left < right


def tail(k: int, n: int, p: float) -> float:
    """Exact P(X <= k) of a binomial with n trials of chance p."""
    if k >= n:
        return 1.0
    logs = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
        for i in range(k + 1)
    ]
    return math.fsum(map(math.exp, logs))


def settings() -> list[tuple[str, int]]:
    """All cutoffs in the fixed order in which they are tried: the most lenient ones of all rules, then the next."""
    longest = max(len(cuts) for *_, cuts in RULES.values())
    return [(rule, cuts[i]) for i in range(longest) for rule, (*_, cuts) in RULES.items() if i < len(cuts)]


def last_certified(steps: Sequence[tuple[int, int, int]], n_good: int, alpha: float, level: float) -> int | None:
    """The step to take, of (step, good documents rejected up to it, bad ones): of those before the first one that is not
    certified the one with the largest difference of bad and good ones, the first at a tie; None if none rejects more bad ones."""
    best, taken = 0, None
    for step, good, bad in sorted(steps):
        if tail(good, n_good, alpha) > level:
            break
        if bad - good > best:
            best, taken = bad - good, step
    return taken


def fit_cutoffs(measures: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum with the chosen cutoff of each rule, null where none is certified or useful.

    ``measures`` has ``doc_id, stratum`` and the measures, ``labels`` has ``doc_id, quality`` (1 good, 0 bad). All
    labelled documents that pass the base rules are the holdout. Cutoffs come from fixed lists and are added one after the other in
    the order of ``settings``; one that rejects no bad document of the stratum is left out, which the good ones
    have no part in. Each step is tested on the good documents that it and all before it reject together: it is certified if
    so few have a chance of at most ``delta`` divided by the number of strata, were the true share over ``alpha``. The first
    step that is not certified ends the sequence. Tests in a fixed order need no division among them, so with probability
    ``1 - delta`` no stratum loses more than ``alpha`` of its good documents, whichever of the certified steps is taken.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    columns = ["stratum", *MEASURES]
    held = materialise(measures.where(~base_failed()).join(known, "doc_id").select(*columns, "quality"))
    tried = settings()
    bad = F.col("quality") == 0
    useful = F.array(*[F.coalesce(F.max(bad & _rejects(r, c)), F.lit(False)) for r, c in tried])
    strata = held.groupBy("stratum").agg(F.count("*").alias("n"), F.sum((~bad).cast("bigint")).alias("n_good"), useful.alias("useful"))
    strata = materialise(strata)
    # The first useful step that rejects a document.
    steps = [F.when(_rejects(r, c) & F.col("useful")[i], F.lit(i)) for i, (r, c) in enumerate(tried)]
    of = strata.select(F.col("stratum").alias("_of"), "useful")
    first = held.join(of, F.col("stratum") == F.col("_of")).select("stratum", bad.alias("bad"), F.least(*steps).alias("step"))
    counts = first.where("step is not null").groupBy("stratum", "step").agg(
        F.sum((~F.col("bad")).cast("bigint")).alias("good"), F.sum(F.col("bad").cast("bigint")).alias("bad")
    )
    per_stratum = counts.groupBy("stratum").agg(F.collect_list(F.struct("step", "good", "bad")).alias("counts"))
    level = delta / max(strata.count(), 1)
    joined = strata.join(per_stratum, "stratum", "left")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = []
            for row in batch.to_pylist():
                rejected = {c["step"]: (c["good"], c["bad"]) for c in row["counts"] or ()}
                good = lost = 0
                reached = []
                for step, used in enumerate(row["useful"]):
                    if used:
                        good, lost = good + rejected.get(step, (0, 0))[0], lost + rejected.get(step, (0, 0))[1]
                        reached.append((step, good, lost))
                taken = last_certified(reached, row["n_good"], alpha, level)
                cuts = dict.fromkeys(RULES) | {"stratum": row["stratum"]}
                for step, *_ in reached:
                    if taken is not None and step <= taken:
                        cuts[tried[step][0]] = tried[step][1]
                chosen.append(cuts)
            columns = [pa.array([c["stratum"] for c in chosen], pa.string())]
            columns += [pa.array([c[rule] for c in chosen], pa.int64()) for rule in RULES]
            yield pa.RecordBatch.from_arrays(columns, names=["stratum", *RULES])

    return joined.mapInArrow(choose, "stratum string, " + ", ".join(f"{rule} bigint" for rule in RULES))


def verdict(measures: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``measures`` with ``base_failed`` and ``kept``; a stratum without cutoffs loses nothing by the rules.

    ``cutoffs`` should be a stored table: by its size the planner decides whether it is sent to every task.
    """
    named = cutoffs.select(F.col("stratum").alias("_stratum"), *[F.col(r).alias(f"_{r}") for r in RULES])
    fired = [F.coalesce(_rejects(rule, F.col(f"_{rule}")), F.lit(False)) for rule in RULES]
    any_fired = fired[0]
    for one in fired[1:]:
        any_fired = any_fired | one
    joined = measures.join(named, F.col("stratum") == F.col("_stratum"), "left")
    out = joined.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & ~any_fired)
    return out.drop("_stratum", *[f"_{r}" for r in RULES])


def measure_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", carry: Sequence[str] = ()
) -> DataFrame:
    """``doc_id, stratum``, the measures of every whole text, and the columns to carry, as ``carried_<name>``.

    Null text is empty; a null stratum is the stratum of the empty name; rows are independent, so null and repeated
    keys stay; an empty table gives no rows; columns that are not named are left out.
    """
    rows = docs.select(
        col(key).alias("doc_id"),
        F.coalesce(col(stratum).cast("string"), F.lit("")).alias("stratum"),
        measured(col(text)).alias("m"),
        *[col(c).alias(f"carried_{c}") for c in carry],
    )
    return rows.select("doc_id", "stratum", *[f"m.{m}" for m in MEASURES], *[f"carried_{c}" for c in carry])


def screen_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` of every document (see ``fit_cutoffs`` for the rules).

    Labels that are null, not 0 or 1, or of unknown documents are not used; if a document has several, the lowest counts.
    """
    measures = materialise(measure_documents(docs, key, text, stratum))
    return verdict(measures, materialise(fit_cutoffs(measures, labels)))
