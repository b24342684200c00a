"""Draws that are made and added per read are those of the plain form, and keys' digests are MD5."""

import hashlib
import random

import numpy as np
from pulsegrid.functions import digest
from pulsegrid.operators import inject, train
from pulsegrid.plans import fixtures as X
from pulsegrid.plans.queries import COMPILED, FORWARD
from pyspark.sql import functions as F

TEXTS = [(i, "".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyzABC .,NKİé", k=n)), "en", f"s{i % 2}") for i, n in [(1, 3000), (2, 10), (30, 1), (44, 2000), (555, 11), (-7, 40), (10**17, 300)]]
TEXTS += [(8, None, "en", "s0"), (9, "", "de", "s1"), (None, "a text without a number", "en", "s0")]


def test_digests_of_decimal_keys():
    before, numbers = [b"", b"0|12|", b"x" * 60, b"12345678|"], [0, 9, 10, 99_999, 123_456_789_012, 4_294_967_296]
    rows, at = (x.ravel() for x in np.meshgrid(np.arange(len(before)), np.array(numbers)))
    for words, behind in zip(digest.decimal_md5(before, rows, at, (b"|ipd", b""), 4), (b"|ipd", b""), strict=True):
        for i in range(len(rows)):
            assert "".join(f"{x:08x}" for x in words[:, i]) == hashlib.md5(before[rows[i]] + b"%d" % at[i] + behind).hexdigest()


def test_sums_of_reads_are_those_of_their_bases(spark, tmp_path, monkeypatch):
    spark.createDataFrame(TEXTS, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    reads, table = X.reads(spark, str(tmp_path)), train.moments(X.reads(spark, str(tmp_path)), COMPILED)
    bases = inject.edge_noise(reads, FORWARD, table, ["doc_id"])
    want = bases.groupBy("doc_id").agg(F.count("*"), F.count_if("is_edge"), F.sum("ipd"), F.sum("pw")).collect()
    assert len(want) == 8
    for source in (reads, X.packed(spark, str(tmp_path))):
        assert sorted(map(repr, map(tuple, inject.edge_noise_sums(source, FORWARD, table, ["doc_id"]).collect()))) == sorted(map(repr, map(tuple, want)))
    none = inject.edge_noise(reads, FORWARD, table.limit(0), ["doc_id"]).agg(F.sum("ipd"), F.sum("pw")).first()
    assert tuple(none) == tuple(inject.edge_noise_sums(reads, FORWARD, table.limit(0), ["doc_id"]).agg(F.sum("sum_ipd"), F.sum("sum_pw")).first())


def test_table_of_a_task_is_that_of_its_slices(spark, tmp_path):
    rows = [(i, "".join(random.Random(i).choices("abcdefghij tuvw", k=30_000)), "en", f"s{i % 2}") for i in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    whole = train.moments(X.packed(spark, str(tmp_path)), COMPILED)  # more windows than DENSE in a task
    apart = train.moments(X.reads(spark, str(tmp_path)), COMPILED, ["strain"]).groupBy("kmer", "meth_id").agg(*[F.sum(m).alias(m) for m in train.MOMENTS])
    assert whole.count() == apart.count() and whole.exceptAll(apart).isEmpty()
