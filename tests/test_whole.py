"""Queries over reads take whole texts and all rows: against plain Python on texts longer than any prefix."""

import hashlib
import random
from collections import Counter

import pytest
from pulsegrid.operators import inject, train
from pulsegrid.plans import fixtures as X
from pulsegrid.plans.queries import COMPILED, QUERIES
from pyspark.sql import functions as F
from test_core import brute_marks, brute_moments

TEXTS = [(i, "".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz .,N", k=n)), lang, f"s{i % 2}") for i, (n, lang) in enumerate([(3000, "en"), (900, "en"), (5, "de"), (2000, "de"), (401, "xx"), (13, "en"), (1500, "en")], 1)]
TEXTS += [(8, None, "en", "s0"), (9, "", "de", "s1")]


def bases(text):
    return "".join("ACGT"[(ord(c) - 97) % 4] for c in (text or "").lower() if "a" <= c <= "z")


def fired(d, n, a, b, c, m):
    return [(d * a + i * b + c) % 256 for i in range(max(0, n - d % m))]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(TEXTS, "doc_id long, text string, lang string, source string").write.parquet(f"{at}/documents.parquet")
    return at


def test_whole_reads(spark, folder):
    got = {r.doc_id: r for r in X.reads(spark, folder).collect()}
    for d, text, _, _ in TEXTS:
        s, r = bases(text), got[d]
        assert r.seq == s and r.fi == fired(d, len(s), 31, 17, 7, 3) and r.fp == fired(d, len(s), 13, 29, 3, 2)
        assert r.ri == fired(d, len(s), 7, 5, 1, 4) and r.rp == fired(d, len(s), 11, 3, 2, 5)


def test_windows_marks_and_moments(spark, folder):
    seqs = {d: bases(t) for d, t, _, _ in TEXTS}
    n = Counter(s[i : i + 11] for s in seqs.values() for i in range(len(s) - 10))
    got = {r.kmer: r.n for r in QUERIES["kmer_sliding"](spark, folder).collect()}
    assert got == {int(k.translate(str.maketrans("ACGT", "0123")), 4): c for k, c in n.items()}
    want = {(d, i, m) for d, s in seqs.items() for i, m in enumerate(brute_marks(s, COMPILED)) if m}
    assert {tuple(r) for r in QUERIES["motif_scan_revcomp"](spark, folder).collect()} == want
    table = brute_moments([(s, fired(d, len(s), 31, 17, 7, 3), fired(d, len(s), 13, 29, 3, 2)) for d, s in seqs.items()], COMPILED)
    assert {(r.kmer, r.meth_id): tuple(r)[2:] for r in QUERIES["dict_train"](spark, folder).collect()} == table


def test_contigs_hold_all_rows_and_bases_follow_them(spark, folder):
    r = X.reads(spark, folder)
    c = {x.species: x.seq for x in X.contigs(r).collect()}
    assert c == {s: "".join(bases(t) for _, t, lang, _ in TEXTS if lang == s) for s in {x[2] for x in TEXTS}}
    got = Counter((x.species, x.read_name) for x in QUERIES["inject_params_mapped"](spark, folder).collect())
    got += Counter((x.species, x.read_name) for x in QUERIES["inject_params_unmapped"](spark, folder).collect())
    assert got == Counter({(lang, f"r{d}"): len(bases(t)) for d, t, lang, _ in TEXTS if bases(t)})
    al = {x.read_name: x for x in inject.last_alignment(X.alignments(r, X.contigs(r))).collect()}
    for x in QUERIES["inject_params_mapped"](spark, folder).collect():
        s = c[x.species]
        at = al[x.read_name].ref_start + x.pos
        window = "".join(s[(at + j) % len(s)] for j in range(-5, 6))
        assert x.kmer == int(window.translate(str.maketrans("ACGT", "0123")), 4) and x.meth_id == brute_marks(s, COMPILED)[at % len(s)] if x.pos % 97 == 0 else True


def test_dump_lists_every_read_and_all_tags(spark, folder, tmp_path):
    got = {r.read_name: tuple(r)[1:] for r in QUERIES["bam_dump"](spark, folder).collect()}
    want = {}
    for d, t, _, _ in TEXTS:
        if s := bases(t):
            want[f"r{d}"] = (s, *[str(fired(d, len(s), *x)) for x in [(31, 17, 7, 3), (7, 5, 1, 4), (13, 29, 3, 2), (11, 3, 2, 5)]])
    assert got == want
    spark.createDataFrame([(i, "some text", "en", "s") for i in range(120)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["bam_dump"](spark, str(tmp_path)).count() == 120


def test_registered_caps_keep_what_the_reference_keeps(spark, tmp_path):
    text = "a" * 12_020  # doc 3: 12,020 bases, 12,010 windows of one key
    spark.createDataFrame([(3, text, "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["sample_cap_extract"](spark, str(tmp_path)).count() == 10_000
    assert QUERIES["sample_totals"](spark, str(tmp_path)).first()[:] == (1, 10_000)
    rows = [(3 * i, "a" * 12_020, "en", f"s{i}") for i in range(1, 7)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/six/documents.parquet")
    assert QUERIES["sample_cap_merge"](spark, f"{tmp_path}/six").count() == 50_000


def test_pool_holds_every_species(spark, tmp_path):
    rows = [(10, "it"), (2, "xx"), (3, None), (1, "en")]
    spark.createDataFrame([(d, "text", s, "s") for d, s in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.place, r.read_name, r.species) for r in QUERIES["pool_species_sorted"](spark, str(tmp_path)).collect())
    assert got == [(1, "r1", "en"), (2, "r2", "xx"), (3, "r3", None), (4, "r10", "it")]


def test_small_caps(spark):
    rows = [(d, p, 1, 0, 1.0, 1.0) for d in range(4) for p in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, pos int, kmer int, meth_id int, ipd float, pw float")
    order = lambda r: hashlib.md5(f"{r[0]}:{r[1]}".encode()).hexdigest()
    got = train.cap(df, 15, F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("pos").cast("string"))))
    assert {tuple(r) for r in got.collect()} == set(sorted(rows, key=order)[:15])
