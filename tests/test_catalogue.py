"""Every query runs on the smallest sample tables and equals its SQL counterpart."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from textpairs.catalogue.queries import ORACLES, QUERIES

SLOW = {"oof_predictions", "fold_metrics", "scored_ensemble"}


@pytest.fixture(scope="module")
def sql(sf_dir):
    connection = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def normal(values):
    out = []
    for v in values:
        if isinstance(v, float):
            v = None if math.isnan(v) else float(f"{v:.9g}") + 0.0
        out.append((v is not None, str(float(v)) if isinstance(v, (int, float)) else str(v)))
    return tuple(out)


def test_flagship(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, sql, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = sorted(normal(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    result = sql.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    wanted = sorted(normal([r[i] for i in at]) for r in result.fetchall())
    assert len(found) > 0 and found == wanted


@pytest.mark.parametrize("name", sorted(SLOW))
def test_model_queries_run(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_only_model_queries_have_no_sql():
    assert set(QUERIES) - set(ORACLES) == SLOW
