"""What the queries on external files write and shuffle."""

from helpers import plan

import __spark_entry__ as driver


def test_texts_of_unnumbered_rows_are_not_shuffled_to_count_numbers(spark, sf_dir):
    found = driver.queries()["external_unnumbered"](spark, sf_dir)
    assert "distinct" not in plan(found).lower()


def test_external_files_are_compressed(spark, sf_dir):
    found = driver.queries()["external_pairs"](spark, sf_dir)
    assert all(name.endswith(".gz") for name in found.inputFiles())
