"""The pipeline's stages on a small table, each held to a plain version of its decision."""

import corpus_pipeline as P
import numpy as np
import pyarrow as pa
from pulsegrid.llm import byte_cnn, decontam, rule_ledger
from pulsegrid.llm.textkernel import bytes_of
from pyspark.sql import functions as F
from test_signature_tree import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols = docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = docs.collect()

    kept = P.quality_stage(spark, docs, SF)
    net = byte_cnn.fit(docs, labels)
    want = {r.doc_id for r in rows if byte_cnn.probability(net, np.frombuffer((r.text or "").encode(), np.uint8)) >= 0.5}
    assert kept.columns == cols and {r.doc_id for r in kept.collect()} == want

    kept = P.rules_stage(spark, docs, SF)
    got = rule_ledger.measure(*bytes_of(pa.array([r.text for r in rows], pa.string())))
    m = {k: v.tolist() for k, v in got.items()}
    fails = lambda i: any(eval(rule, {}, {k: v[i] for k, v in m.items()}) for name, rule in rule_ledger.RULES if rule_ledger.POLICIES["web-2"] & rule_ledger.BIT[name])  # noqa: E731, S307
    assert kept.columns == cols and {r.doc_id for r in kept.collect()} == {r.doc_id for i, r in enumerate(rows) if not fails(i)}

    kept = P.near_duplicate_stage(spark, docs, SF)
    want = {c for _, _, c in brute([(r.doc_id, r.text) for r in rows], 5, 4, 5)}
    assert kept.columns == cols and {r.doc_id for r in kept.collect()} == want

    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    kept = P.decontamination_stage(spark, docs, SF)
    index = decontam.Index([(b.item_id, b.text) for b in bench.collect()])
    leaked = {rows[i].doc_id for i, r in enumerate(rows) if list(index.leaks(*bytes_of(pa.array([r.text], pa.string()))))}
    assert kept.columns == cols and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows} - leaked
    planted = {r.doc_id for r in rows for b in index_texts(bench) if b in (r.text or "")}
    assert planted <= leaked


def index_texts(bench):
    return [b.text for b in bench.collect()]


def test_run_and_edge_rows(spark):
    out = P.run(spark, SF).collect()
    assert out and len({r.doc_id for r in out}) == len(out) and all(0 <= r.taken <= 3 * r.size for r in out)
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "a", 0), (1, "x", "en", "a", 1), (1, "x", "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for df in (odd, odd.limit(0)):
        for _, stage in P.STAGES:
            assert stage(spark, df, SF).count() <= 4


def test_stages_keep_columns_that_clash(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    clash = ["score", "n_words", "failed_bits", "whole", "column0", "tk", "first", "least", "key", "_text", "hash", "nid"]
    rich = docs.select("*", *[F.lit(777 + i).alias(c) for i, c in enumerate(clash)], F.create_map(F.lit("k"), F.col("doc_id")).alias("m"))
    for name, stage in P.STAGES[:4]:
        got = stage(spark, rich, SF)
        assert got.columns == rich.columns, name
        for x in got.collect():
            assert [x[c] for c in clash] == [777 + i for i in range(len(clash))] and x.m == {"k": x.doc_id}
        assert {x.doc_id for x in got.collect()} == {x.doc_id for x in stage(spark, docs, SF).collect()}, name
