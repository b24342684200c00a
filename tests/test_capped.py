"""Capped samples: the rows of the plain form, whichever caps are met, and no window moved that is neither returned nor near a cap."""

import random

import pytest
from pulsegrid.operators import train
from pulsegrid.plans import fixtures as X
from pulsegrid.plans.queries import COMPILED, QUERIES, _order


def texts(spark, at, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{at}/documents.parquet")
    return str(at)


def plain(spark, sf, limit, total):
    per = train.samples(X.reads(spark, sf), COMPILED, ["doc_id", "strain"])
    return train.cap(train.cap(per, limit, _order(), ("kmer", "meth_id", "strain")).drop("strain"), total, _order())


@pytest.mark.parametrize(("limit", "total"), [(20, 50), (100, 100), (500, 40), (10**6, 10**6)])
def test_rows_are_those_of_the_plain_form(spark, tmp_path, limit, total):
    words = ["gattaca", "bcd", "aaaaaaaaaaaaaaaaaa", "quick", "brown"]
    rows = [(i * 37 - 5, " ".join(random.Random(i).choices(words, k=150)), "en", [None, "s1", "s2"][i % 3]) for i in range(12)] + [(5000, None, "en", "s1")]
    sf = texts(spark, tmp_path, rows)
    got, want = train.capped_samples(X.packed(spark, sf), COMPILED, "doc_id", "strain", limit, total), plain(spark, sf, limit, total)
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_equal_orders_at_a_cap(spark, tmp_path):
    sf = texts(spark, tmp_path, [(7, "a" * 100, "en", "s1")] * 4)  # four windows of each order
    assert train.capped_samples(X.packed(spark, sf), COMPILED, "doc_id", "strain", 30, 60).count() == 30


def test_returned_windows_are_not_shuffled(spark, tmp_path):
    sf = texts(spark, tmp_path, [(3 * i, "a" * 12_020, "en", f"s{i}") for i in range(1, 7)])
    df = QUERIES["sample_cap_merge"](spark, sf)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString() and df.count() == 50_000
