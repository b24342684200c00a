"""Samples capped by key alone: the rows of the plain form, and few windows ranked."""

import random

import pytest
from pulsegrid.operators import train
from pulsegrid.plans import fixtures as X
from pulsegrid.plans.queries import COMPILED, QUERIES, _order


def texts(spark, at, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{at}/documents.parquet")
    return str(at)


@pytest.mark.parametrize("limit", [3, 150, 2000, 10**6])
def test_rows_are_those_of_the_plain_form(spark, tmp_path, limit, monkeypatch):
    words = ["gattaca", "bcd", "aaaaaaaaaaaaaaaaaa", "quick", "brown"]
    rows = [(i * 37 - 5, " ".join(random.Random(i).choices(words, k=600)), "en", f"s{i % 3}") for i in range(12)] + [(5000, None, "en", "s1")]
    sf = texts(spark, tmp_path, rows)
    want = train.cap(train.samples(X.reads(spark, sf), COMPILED, ["doc_id"]), limit, _order())
    monkeypatch.setattr(train, "cap", None)  # no way back to the plain form
    got = train.capped_samples(X.packed(spark, sf), COMPILED, "doc_id", None, limit, limit)
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_equal_orders_at_a_cap(spark, tmp_path):
    sf = texts(spark, tmp_path, [(7, "a" * 100, "en", "s1")] * 4)
    assert train.capped_samples(X.packed(spark, sf), COMPILED, "doc_id", None, 30, 30).count() == 30


def test_returned_windows_are_not_shuffled(spark, tmp_path):
    sf = texts(spark, tmp_path, [(3 * i, "a" * 12_020, "en", f"s{i}") for i in range(1, 7)])
    df = QUERIES["sample_cap_extract"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and df.count() == 10_000
