"""Certified cutoffs: order of the steps, guarantee by simulation, small strata, odd labels."""

import random

import cases
import numpy as np
from pyspark.sql import functions as F

from textpairs.llm import catalogue
from textpairs.llm.common import table
from textpairs.llm.quality import ALPHA, DELTA, RULES, fit_cutoffs, last_certified, measure_documents, screen_documents, settings, tail


def test_settings_hold_every_cutoff_from_lenient_to_strict():
    tried = settings()
    assert sorted(tried) == sorted((rule, cut) for rule, (*_, cuts) in RULES.items() for cut in cuts)
    for rule, (*_, cuts) in RULES.items():
        assert [cut for r, cut in tried if r == rule] == list(cuts)


def test_sequence_ends_at_the_first_step_that_is_not_certified():
    level = DELTA / 4
    assert last_certified([(0, 0, 5), (1, 0, 9), (2, 90, 40), (3, 90, 99)], 100, ALPHA, level) == 1
    assert last_certified([(0, 0, 5), (1, 0, 5)], 100, ALPHA, level) == 0
    assert last_certified([(0, 0, 5)], 85, ALPHA, level) is None and last_certified([(0, 0, 5)], 86, ALPHA, level) == 0
    assert last_certified([(0, 3, 3)], 1000, ALPHA, level) is None and last_certified([], 1000, ALPHA, level) is None
    # The largest difference of the certified ones, not the last.
    assert last_certified([(0, 0, 5), (4, 8, 9)], 1000, ALPHA, level) == 0


def test_guarantee():
    """Shares of good documents rejected step by step, some over the limit: a step over it is seldom taken."""
    rng = np.random.default_rng(5)
    for shares in ([0.051], [0.0, 0.02, 0.055], [0.01, 0.052, 0.08, 0.3]):
        wrong = 0
        for _ in range(3000):
            n = int(rng.integers(60, 400))
            place = np.searchsorted(shares, rng.random(n))
            steps = [(s, int((place <= s).sum()), 10**6 * (s + 1)) for s in range(len(shares))]
            taken = last_certified(steps, n, ALPHA, DELTA)
            wrong += taken is not None and shares[taken] > ALPHA
        assert wrong / 3000 <= DELTA + 0.01


def junk(rng, bad, n=60):
    return " ".join(f"word{rng.randrange(9999)}" + ("###" if bad else "") for _ in range(n))


def test_each_stratum_by_its_own_labels(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for lang, good, bad in (("aa", 150, 30), ("bb", 60, 30), ("cc", 150, 0), (None, 150, 10)):
        for i in range(good + bad):
            rows.append((len(rows), junk(rng, i >= good), lang, "s", 0))
            labels.append((len(labels), int(i < good), 0))
    rows.append((len(rows), junk(rng, True), "dd", "s", 0))
    labels += [(None, 0, 0), (0, None, 0), (1, 7, 0), (10**9, 0, 0), (2, 1, 0), (2, 1, 0)]
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    cut = {r.stratum: r.symbols for r in fit_cutoffs(measure_documents(docs), known).collect()}
    assert cut == {"aa": 1500, "bb": None, "cc": None, "": 1500}
    kept = {r.doc_id for r in screen_documents(docs, known).where("kept").collect()}
    bad = {i for i, text, *_ in rows if "###" in text}
    assert {r[0] for r in rows} - kept == {i for i in bad if rows[i][2] in ("aa", None)}
    assert fit_cutoffs(measure_documents(docs), known.where("false")).count() == 0


def test_table_has_certified_cutoffs(spark):
    sf = "/root/testdata/sf0.01"
    found = fit_cutoffs(measure_documents(table(spark, sf, "documents")), table(spark, sf, "labels")).collect()
    assert any(r[rule] is not None for r in found for rule in RULES)
    rows = catalogue.QUERIES["op3_risk_controlled"](spark, sf)
    assert rows.where(~F.col("kept") & ~F.col("base_failed")).count() > 0
    assert tail(0, 86, ALPHA) <= DELTA / 4 < tail(0, 85, ALPHA)
