"""Scalars, scans, windows, sources, networks and the command line against plain Python."""

import gzip
import os
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pulsegrid.functions import kmer
from pulsegrid.gan import infer, model
from pulsegrid.gan import train as gan
from pulsegrid.operators import inject, motifs, prepare, train
from pulsegrid.sources import files
from pyspark.sql import functions as F


def brute_marks(seq, compiled, stop=None):
    n = len(seq) if stop is None else stop
    out = [0] * len(seq)
    for m in compiled:
        for hit in re.finditer(f"(?=({m.regex}))", seq[:n]):
            t = hit.start() + m.offset
            if 0 <= t < n:
                out[t] = m.meth_id
    return out


def brute_moments(reads, compiled):
    acc = defaultdict(lambda: np.zeros(5))
    for seq, fi, fp in reads:
        if seq is None or fi is None or fp is None or len(seq) < 11:
            continue
        n = min(len(seq), len(fi), len(fp))
        marks = brute_marks(seq, compiled, n)
        for i in range(n - 10):
            k = 0
            for c in seq[i : i + 11]:
                k = k * 4 + "ACGT".find(c) if c in "ACGT" else k * 4
            x, y = fi[i + 5], fp[i + 5]
            acc[k, marks[i + 5]] += [1, x, x * x, y, y * y]
    return {k: tuple(v) for k, v in acc.items()}


MOTIFS = motifs.compile_motifs("m6A,GATC,1;m4C,CCWGG,1;odd,GANTC,1;m5C,NNRY,0;m6A,AC,5")


@settings(max_examples=200, deadline=None)
@given(st.text("ACGTNacgtR", max_size=60))
def test_scan_equals_regex(seq):
    seq = seq.replace("R", "N")
    got = kmer.scan(np.frombuffer(seq.encode(), np.uint8), np.array([0]), np.array([len(seq)]), MOTIFS)
    assert got.tolist() == brute_marks(seq, MOTIFS)


def test_rows_do_not_run_into_each_other():
    a, b = "GATCGA", "TCGATC"
    got = kmer.scan(np.frombuffer((a + b).encode(), np.uint8), np.array([0, 6]), np.array([6, 12]), MOTIFS)
    assert got.tolist() == brute_marks(a, MOTIFS) + brute_marks(b, MOTIFS)


def test_kmers_round_trip(spark):
    ks = [0, 1, 4**11 - 1, 123456]
    rows = spark.createDataFrame([(k,) for k in ks], "k int").select("k", kmer.decode(F.col("k")).alias("s")).select("k", kmer.encode(F.col("s")).alias("e"), kmer.reverse_complement(kmer.reverse_complement(F.col("s"))).alias("rr"), "s").collect()
    assert [r.e for r in rows] == ks and all(r.rr == r.s for r in rows)
    assert spark.createDataFrame([("ACN",)], "s string").select(kmer.encode(F.col("s")).alias("e")).first().e is None
    kmer.register(spark)
    assert spark.sql("select kmer_decode(kmer_encode('ACGTACGTACG')) a, revcomp('AACR') b").first().asDict() == {"a": "ACGTACGTACG", "b": "YGTT"}


def test_moments_equal_brute_force_and_merge(spark):
    r = random.Random(5)
    reads = []
    for _ in range(60):
        n = r.choice([0, 5, 11, 12, 80])
        s = "".join(r.choice("ACGTACGTACGTN") for _ in range(n))
        reads.append((s, [r.randrange(256) for _ in range(max(0, n - r.randrange(3)))], [r.randrange(256) for _ in range(n)]))
    reads += [(None, [1], [1]), ("ACGTACGTACGTAC", [1] * 14, None), ("ACGTACGTACGTAC", None, [1] * 14)]
    df = spark.createDataFrame([(*x, i % 3) for i, x in enumerate(reads)], "seq string, fi array<int>, fp array<int>, g int")
    key = lambda rows: {(x.kmer, x.meth_id): (x.n, x.sum_ipd, x.sum_ipd2, x.sum_pw, x.sum_pw2) for x in rows}
    want = brute_moments(reads, MOTIFS)
    assert key(train.moments(df, MOTIFS).collect()) == want
    parts = [train.moments(df.where(f"g = {k}"), MOTIFS) for k in range(3)]
    assert key(train.merge(parts[2].unionByName(parts[0]).unionByName(parts[1])).collect()) == want
    by = train.moments(df, MOTIFS, ["g"])
    assert key(train.merge(by).collect()) == want
    assert train.samples(df, MOTIFS, ["g"]).count() == sum(v[0] for v in want.values())
    assert train.moments(df.limit(0), MOTIFS).count() == 0


def test_motif_sources(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("motifString,centerPos,modificationType,fraction,nDetected\nGATC,1,m6A,1,20\nGCCGGCY,1,modified_base,0.406229,7161\nGT,0,modified_base,0.9,99\nAC,0,m6A,0.39,99\nCTGCAG,4,m6A,0.9553571,3638\n")
    assert motifs.load(spark, str(p)) == "m6A,GATC,1,20,1;m4C,GCCGGCY,1,7161,0.406229;m6A,CTGCAG,4,3638,0.955357"
    q = tmp_path / "r.txt"
    q.write_text("# enzymes\nGATC\t2(6)\nshort\nGCWGC 2(4),-1(6),0(6),9(6),1(8)\n")
    assert motifs.load(spark, str(q)) == "m6A,GATC,1;m4C,GCWGC,1;m6A,GCWGC,4"
    q.write_text("ID   x\nRS   GA^TC;\nMS   2(6mA)\n//\nID   y\nRS   ?\nMS   1(6)\n//\nID   z\nRS   CC\nMS   1(5)\n")
    assert motifs.load(spark, str(q)) == "m6A,GATC,1"
    assert motifs.load(spark, "m6A,A,0") == "m6A,A,0"
    m = tmp_path / "map"
    m.write_text("b|m4C,CC,0\na|m6A,GATC,1\na|x\n")
    assert motifs.species_motifs(spark, str(m), "a") == "m6A,GATC,1"
    with pytest.raises(SystemExit):
        prepare.pairs(["one"])


@pytest.mark.parametrize(
    "text, want",
    [
        ("CCWGG 2(5),-1(4)\nGATC 2(6)", "m5C,CCWGG,1;m4C,CCWGG,4;m6A,GATC,1"),  # 6: m6A, 5: m5C, 4: m4C
        ("GATC 2(66),0(6),-4(6),-5(6)", "m6A,GATC,0"),
        ("ID   a\nRS   TCGA, ?;\nMS   4(6mA)\n//", "m6A,TCGA,3"),
        ("ID   a\nRS   GATC\nMS   2(6),2(6mA)\n//", "m6A,GATC,1"),  # numbers are unknown in records
        ("ID   a\n//\nRS\tGTAC, 2;\nMS\t3(6mA),4(N4mC)\n//", "m6A,GTAC,2;m4C,GTAC,3"),
        ("ID   a\nRS   CC\nRS   GGCC\nMS   1(5mC)\nMS   3(5mC),-1(N4mC)\n//", "m5C,GGCC,2;m4C,GGCC,3"),
        ("ID   a\nRS   GATC\nMS   ?\n//\nID   b\nRS   GATC\nMS   2(6mA)", ""),
    ],
)
def test_enzyme_databases(text, want):
    assert motifs.parse_rebase(text.split("\n")) == want


def test_fuzzy_hits(spark, tmp_path):
    row = lambda contig, start, stop, strand, attrs: "\t".join([contig, "tool", "match", str(start), str(stop), "0", strand, ".", attrs])
    lines = [
        "##gff-version 3", "", row("c", 1, 4, "+", "Pattern_name=m6A_GATC_1"), row("c", 5, 8, "-", "ID=x.1;Name=m4C_CCWGG_1;Note=y"), row("c", 9, 12, "+", "pattern=m5C_RCCGGY_2"), "c\ttool\tmatch\t1\t2",
        row("c", 1, 4, "+", "note=none"), row("c", 2, 5, "+", "name=zzz_A_0"), row("c", 5, 8, "-", "NAME=m5C_CC_1"), row("c", 15, 18, "+", "Name=m6A_GATC_3"), row("gone", 1, 4, "+", "Name=m6A_GATC_1"), row("c", 12, 12, "+", "Name=own_name"), row("c", 1, 1, "-", "Name=m6A_GATC_3"),
    ]
    (tmp_path / "hits.gff").write_text("\n".join(lines) + "\n")
    hits = motifs.read_gff(spark, str(tmp_path / "hits.gff"))
    assert hits.count() == 10
    known = spark.createDataFrame([("own_name", 2, 0), ("m6A_GATC_1", 1, 1)], "name string, meth_id int, pos int")
    got = motifs.gff_marks(hits, spark.createDataFrame([("c", "A" * 16)], "contig string, seq string"), known).collect()
    # place 1: m6A, erased by zzz; place 6: m4C, then m5C; place 0: no name; 17 lies outside, as does -3
    assert sorted((r.contig, r.pos, r.meth_id) for r in got) == [("c", 6, 3), ("c", 10, 3), ("c", 11, 2)]
    assert motifs.known_patterns("m6A,GATC,1;m6A,GATC,1,5;x;odd,CC,0") == [("m6A_GATC_1", 1, 1), ("odd_CC_0", 0, 0)]


def test_edge_noise(spark):
    r = random.Random(8)
    seqs = ["".join(r.choice("ACGTACGTACGTN") for _ in range(n)) for n in (40, 11, 10, 3, 0, 200)] + [None]
    reads = spark.createDataFrame(list(enumerate(seqs)), "doc_id int, seq string")
    forward = motifs.compile_motifs("m6A,GATC,1;m4C,CNA,1", both_strands=False)
    code = lambda w: int("".join(c if c in "ACGT" else "A" for c in w).translate(str.maketrans("ACGT", "0123")), 4)
    keys = {(code(s[i - 5 : i + 6]), brute_marks(s, forward)[i]) for s in seqs if s for i in range(5, len(s) - 5)}
    table = spark.createDataFrame([(k, m, 4, 4.0 * (k % 7), 4.0 * (k % 7) ** 2, 8.0, 16.0) for k, m in sorted(keys) if k % 3], "kmer int, meth_id int, n long, sum_ipd double, sum_ipd2 double, sum_pw double, sum_pw2 double")
    plain = [k % 7 for k, m in keys if k % 3 and m == 0]
    got = {(x.doc_id, x.pos): x for x in inject.edge_noise(reads, forward, table, ["doc_id"]).collect()}
    assert len(got) == sum(len(s or "") for s in seqs)
    for d, s in enumerate(seqs):
        for i in range(len(s or "")):
            x, edge = got[d, i], i < 5 or i > len(s) - 6
            assert x.is_edge == edge and x.meth_id == brute_marks(s, forward)[i] and x.kmer == (None if edge else code(s[i - 5 : i + 6]))
            mean, dev = (sum(plain) / len(plain), 0.2) if edge else (x.kmer % 7, 0.0) if x.kmer % 3 else (1.0, 0.1)
            assert abs(x.ipd / 255 - max(0, mean)) <= 5 * dev + 1 / 255
            if not edge and x.kmer % 3:
                assert x.ipd == 255 * (x.kmer % 7) and x.pw == 510
    assert inject.edge_noise(reads, forward, table.limit(0), ["doc_id"]).count() == len(got)


def test_files_round_trip(spark, tmp_path):
    files.register(spark)
    (tmp_path / "a.fq").write_text("@r1 extra\nACGT\n+\nIIII\n@r2\nGG\n+\n!!\n")
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write("@r3\nTTT\n+\nABC\n")
    got = spark.read.format("fastq").load(str(tmp_path))
    assert sorted((r.read_name, r.seq, r.qual, r.ord) for r in got.collect()) == [("r1", "ACGT", "IIII", 0), ("r2", "GG", "!!", 1), ("r3", "TTT", "ABC", 0)]
    (tmp_path / "x.fna").write_text("junk\n>c1 d\nac\nGT\n>c2\n\n>c1\nTTTT\n")
    assert [(r.contig, r.seq) for r in spark.read.format("fasta").load(str(tmp_path / "x.fna")).orderBy("ord").collect()] == [("c1", "ACGT"), ("c2", ""), ("c1", "TTTT")]
    (tmp_path / "x.maf").write_text("a\ns chr1 100 50 + 5000 ACGT\ns r1 0 50 - 50 ACGT\ns other 1 2 + 3 A\n\na\ns chr2 7 5 + 60 A\ns r1 0 5 + 5 A\n")
    assert [tuple(r)[:6] for r in spark.read.format("maf").load(str(tmp_path / "x.maf")).orderBy("ord").collect()] == [("r1", "chr1", 100, "+", 5000, 0), ("r1", "chr2", 7, "+", 60, 1)]
    rows = [(f"read/{i}", "ACGTN"[: i % 6] * (1 + i % 3), "I" * (len("ACGTN"[: i % 6]) * (1 + i % 3)), [i % 256] * i, None if i % 4 else [1, 255], "s1" if i % 2 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "read_name string, seq string, qual string, fi array<int>, fp array<int>, rg string").repartition(3)
    out = str(tmp_path / "out")
    df.write.format("bam").mode("append").option("groups", "s1").save(out)
    assert all(open(os.path.join(out, p), "rb").read().endswith(files.EOF_BLOCK) for p in os.listdir(out))
    back = {r.read_name: (r.seq or "", r.qual or "", r.fi, r.fp, r.rg, r.flag) for r in spark.read.format("bam").load(out).collect()}
    assert back == {n: (s, q if s else "", fi, fp, rg, 4) for n, s, q, fi, fp, rg in rows}


def test_inject_end_to_end(spark, tmp_path):
    r = random.Random(1)
    genome = "".join(r.choice("ACGT") for _ in range(300))
    reads = spark.createDataFrame([("s", "m1", genome[290:] + genome[:50], 0), ("s", "u1", genome[:30], 1), ("s", "short", "ACG", 2), ("t", "m1", "ACGTACGTACGTACG", 3)], "species string, read_name string, seq string, ord int")
    aln = spark.createDataFrame([("s", "m1", "c", 5, "+", 300, 0), ("s", "m1", "c", 290, "+", 300, 1), ("s", "short", "c", 298, "-", 300, 2)], "species string, read_name string, ref_name string, ref_start long, ref_strand string, ref_src_size long, ord long")
    refs = spark.createDataFrame([("s", "c", genome)], "species string, contig string, seq string")
    j = inject.mapped(reads, aln, refs)
    cm, rm = train.marks(refs, MOTIFS, ["species", "contig"]), train.marks(reads, MOTIFS, ["species", "read_name"])
    bases = inject.mapped_bases(j, cm).collect()
    wrap = genome * 3
    for b in bases:
        start = 290 if b.read_name == "m1" else 298
        w = wrap[300 + start + b.pos - 5 :][:11]
        k = 0
        for c in w:
            k = k * 4 + "ACGT".index(c)
        assert b.kmer == k and b.meth_id == brute_marks(genome, MOTIFS)[(start + b.pos) % 300] and not b.is_n
    assert sum(b.is_n for b in inject.mapped_bases(j, cm, circular=False).where("read_name = 'm1'").collect()) > 0
    table = spark.createDataFrame([(b.kmer, b.meth_id, 4, 40.0, 400.0, 80.0, 1600.0) for b in bases if b.read_name == "m1"], "kmer int, meth_id int, n long, sum_ipd double, sum_ipd2 double, sum_pw double, sum_pw2 double").distinct()
    out = {(x.species, x.read_name): x for x in inject.inject(reads, aln, refs, cm, rm, table).collect()}
    assert len(out) == 4 and out["s", "m1"].fi == [10] * 60 and out["s", "m1"].fp == [20] * 60  # a deviation of 0
    assert all(len(x.fi) == len(x.fp) == len(x.seq) for x in out.values())
    assert set(out["s", "u1"].fi) <= {1, 10} and out["t", "m1"].fi == [1] * 15


def test_natural_order(spark):
    names = ["S1_10", "S1_2", "S2_1", "r", "S1_2a"]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(inject.natural_key("n")).collect()]
    assert got == ["S1_2", "S1_2a", "S1_10", "S2_1", "r"]


def test_penalty_gradient_equals_finite_differences():
    r = np.random.default_rng(0)
    d = model.new_critic(embed=3, hidden=6, dropout=0.0, ids=np.arange(5), seed=2)
    real, fake, k, m = r.normal(size=(7, 2)), r.normal(size=(7, 2)), r.integers(0, 5, 7), r.integers(0, 4, 7)
    value, g = gan.penalty(d, real, fake, k, m, np.random.default_rng(9))
    worst = 0.0
    for name, p in d.parameters().items():
        if name == "b2":
            continue
        flat = p.reshape(-1)
        for i in range(0, len(flat), max(1, len(flat) // 7)):
            old, e = flat[i], 1e-5
            flat[i] = old + e
            up = gan.penalty(d, real, fake, k, m, np.random.default_rng(9))[0]
            flat[i] = old - e
            down = gan.penalty(d, real, fake, k, m, np.random.default_rng(9))[0]
            flat[i] = old
            worst = max(worst, abs((up - down) / (2 * e) - g[name].reshape(-1)[i]))
    assert worst < 1e-4, worst


def test_networks_train_resume_and_generate(spark, tmp_path):
    rows = [(i % 6, i % 4, float(20 + i % 5), float(10 + i % 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "kmer int, meth_id int, ipd float, pw float")
    at = gan.fit(df, str(tmp_path), epochs=2, batch=32, noise=4, embed=5)
    g, _, settings, arrays = model.load(at)
    assert settings["noise_dim"] == 4 and int(arrays["epoch"]) == 2 and int(arrays["step"]) == 2
    at = gan.fit(df, str(tmp_path), epochs=3, batch=32, noise=4, embed=5, resume=at)
    assert int(model.load(at)[3]["epoch"]) == 3 and len((tmp_path / "training_log.csv").read_text().splitlines()) == 4
    ctx = spark.createDataFrame([("r", i, i if i else None, 0) for i in range(8)], "name string, pos int, kmer int, meth_id int")
    a, b = (sorted(map(tuple, infer.generate(x, g).collect())) for x in (ctx, ctx.repartition(5)))
    assert a == b and a[0][-2:] == (1, 1) and all(0 <= x[-1] <= 255 for x in a)


def test_streaming_equals_batch(spark, tmp_path):
    from pulsegrid.streaming import train as stream

    df = spark.createDataFrame([("ACGTACGTACGTACGATC" * 2, list(range(36)), list(range(36)))] * 5, "seq string, fi array<int>, fp array<int>")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.append_shards(live, MOTIFS, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = train.merge(spark.read.parquet(str(tmp_path / "out")))
    cols = ["kmer", "meth_id", *train.MOMENTS]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, train.moments(df, MOTIFS).select(cols).collect()))


def test_command_line(spark, tmp_path, capsys):
    from pulsegrid import cli

    files.register(spark)
    r = random.Random(2)
    genome = "".join(r.choice("ACGT") for _ in range(400))
    sub = tmp_path / "meta" / "sp1"
    sub.mkdir(parents=True)
    (sub / "sp1.fq").write_text("".join(f"@sp1_{i}\n{genome[i : i + 60]}\n+\n{'I' * 60}\n" for i in range(0, 300, 60)))
    (sub / "sp1.maf").write_text("".join(f"a\ns c {i} 60 + 400 A\ns sp1_{i} 0 60 + 60 A\n\n" for i in range(0, 240, 60)))
    (sub / "sp1.fna").write_text(f">c\n{genome}\n")
    (sub / "m.csv").write_text("motifString,centerPos,modificationType,fraction,nDetected\nGATC,1,m6A,1,20\n")
    reads = spark.createDataFrame([(f"x{i}", genome, [i + 1] * 400, [2] * 400) for i in range(4)], "read_name string, seq string, fi array<int>, fp array<int>")
    bam = str(tmp_path / "bam")
    reads.coalesce(1).write.format("bam").mode("append").save(bam)
    t = str(tmp_path / "t.parquet")
    cli.main(["dictionary", "train", bam, "m6A,GATC,1", t])
    cli.main(["dictionary", "merge", t, t, str(tmp_path / "t2.parquet")])
    cli.main(["dictionary", "analyze", str(tmp_path / "t2.parquet")])
    assert "none:" in capsys.readouterr().out
    cli.main(["dictionary", "inject", str(sub), t, "m6A,GATC,1", str(tmp_path / "inj")])
    assert spark.read.format("bam").load(str(tmp_path / "inj" / "sp1")).where("size(fi) = 60").count() == 5
    cli.main(["dictionary", "metagenome", str(tmp_path / "meta"), t, str(tmp_path / "pool")])
    pooled = spark.read.format("bam").load(str(tmp_path / "pool"))
    assert {x.rg for x in pooled.collect()} == {"sp1"} and pooled.count() == 5
    s = str(tmp_path / "s.parquet")
    cli.main(["cgan", "extract", bam, "m6A,GATC,1", s, "--max-samples", "3"])
    cli.main(["cgan", "merge", s, s, str(tmp_path / "s2.parquet"), "--max-samples", "5"])
    assert spark.read.parquet(str(tmp_path / "s2.parquet")).groupBy("kmer", "meth_id").count().agg(F.max("count")).first()[0] <= 5
    cli.main(["cgan", "train", str(tmp_path / "s2.parquet"), str(tmp_path / "g"), "--epochs", "1", "--batch-size", "64", "--kmer-embed-dim", "4"])
    cli.main(["cgan", "generate", str(sub), str(tmp_path / "g" / "checkpoint_1.npz"), "m6A,GATC,1", str(tmp_path / "gen")])
    assert spark.read.format("bam").load(str(tmp_path / "gen" / "sp1")).where("size(fi) = 60").count() == 5
    cli.main(["stats", bam, str(tmp_path / "stats")])
    (tmp_path / "pairs").write_text("a.bam\nm6A,GATC,1\nb.bam\n/no/such.csv\n")
    cli.main(["prepare", str(tmp_path / "pairs"), str(tmp_path / "ready")])
    assert (tmp_path / "ready").read_text() == "a.bam\nm6A,GATC,1\n"
    cli.main(["rebase", "patterns", "m6A,GATC,1;m6A,GATC,1", str(tmp_path / "pat")])
    assert (tmp_path / "pat").read_text() == ">m6A_GATC_1\nGATC\n"
    with pytest.raises(SystemExit, match="did you mean prepare"):
        cli.main(["prepar"])


def test_split_files_read_like_whole_ones(spark, tmp_path, monkeypatch):
    r = random.Random(12)
    seqs = ["".join(r.choice("ACGT") for _ in range(r.choice([0, 5, 60, 300]))) for _ in range(200)]
    (tmp_path / "x.fq").write_text("".join(f"@r{i} @x\n{s}\n+{'@' * (i % 2)}\n{'@' * min(1, len(s))}{'+I@'[i % 3] * max(0, len(s) - 1)}\n" + "\n" * (i % 40 == 7) for i, s in enumerate(seqs)))
    (tmp_path / "x.maf").write_text("##maf\n" + "".join(f"a score={i}\ns c{i % 3} {i} 5 + 900 {s}A\ns r{i} 0 5 + 5 A{s}\n\n" for i, s in enumerate(seqs)))
    whole = {kind: list(f(str(tmp_path / f"x.{end}"))) for kind, f, end in (("fastq", files.fastq, "fq"), ("maf", files.maf, "maf"))}
    assert len(whole["fastq"]) == len(whole["maf"]) == 200
    for split in (17, 100, 1000):
        monkeypatch.setattr(files, "SPLIT", split)
        for kind, f, end in (("fastq", files.fastq, "fq"), ("maf", files.maf, "maf")):
            path = str(tmp_path / f"x.{end}")
            got = [row for lo in range(0, os.path.getsize(path), split) for row in f(path, lo, lo + split)]
            assert [x[:-1] for x in got] == [x[:-1] for x in whole[kind]] and [x[-1] for x in got] == sorted({x[-1] for x in got})


def test_split_bam_reads_like_a_whole_one(spark, tmp_path, monkeypatch):
    r = random.Random(13)
    at = str(tmp_path / "x.bam")
    with open(at, "wb") as f:
        w = files.BgzfWriter(f)
        w.write(files.header(["g"]))
        for i in range(120):
            n = r.choice([0, 1, 12, 500, 40_000]) if i % 3 else 200
            w.write(files.record(f"m/{i}", "".join(r.choice("ACGT") for _ in range(n)), None, [r.choice([0, 255, r.randrange(256)]) for _ in range(n)], [255] * n if i % 5 else None, "g"))
            if r.random() < 0.1 and w.held:
                w._block(bytes(w.held))
                w.held.clear()
        w.close()
    whole = list(files.bam(at))
    assert [x[0] for x in whole] == [f"m/{i}" for i in range(120)]
    for split in (3000, 40_000, 300_000):
        monkeypatch.setattr(files, "SPLIT", split)
        got = [row for lo in range(0, os.path.getsize(at), split) for row in files.bam(at, lo, lo + split)]
        assert [x[:-1] for x in got] == [x[:-1] for x in whole] and [x[-1] for x in got] == sorted({x[-1] for x in got})
    files.register(spark)
    assert spark.read.format("bam").load("file://" + at).count() == 120


def test_broken_files_lists_and_one_pooled_file(spark, tmp_path):
    files.register(spark)
    df = spark.createDataFrame([(f"r{i}", "ACGT" * 5, [i] * 20, [1] * 20, f"s{i % 2}") for i in range(50)], "read_name string, seq string, fi array<int>, fp array<int>, rg string")
    one = str(tmp_path / "pool.bam")
    for _ in range(2):  # a second run replaces the first
        df.repartition(4).orderBy(inject.natural_key("read_name")).write.format("bam").mode("append").option("single", "true").option("groups", "s0,s1").option("order", "queryname").save(one)
        assert os.path.isfile(one) and not os.path.exists(one + ".parts")
    with gzip.open(one) as f:
        assert b"SO:queryname\n@RG\tID:s0" in f.read(200)
    assert [x[0] for x in files.bam(one)] == [f"r{i}" for i in range(50)]
    folder = str(tmp_path / "parts")
    for _ in range(2):
        df.repartition(3).write.format("bam").mode("overwrite").save(folder)
    assert spark.read.format("bam").load(folder).count() == 50
    (tmp_path / "bad.bam").write_bytes(open(one, "rb").read()[:200])
    (tmp_path / "no.bam").write_bytes(b"nothing")
    (tmp_path / "list").write_text(f"{one}\n\n{tmp_path}/bad.bam\n{tmp_path}/no.bam\n{tmp_path}/gone.bam\n")
    got = spark.read.format("bam").option("errors", "rows").load(f"@{tmp_path}/list")
    assert sorted({os.path.basename(x.file) for x in got.where("error is not null").collect()}) == ["bad.bam", "gone.bam", "no.bam"]
    assert got.where("error is null").count() == 50
    kmer.register(spark)
    assert spark.sql("select iupac_regex('GANTCRx')").first()[0] == "GA.TC[AG]x"


@pytest.mark.parametrize("circular", [True, False])
def test_tiles_give_the_bases_that_contexts_give(spark, monkeypatch, circular):
    monkeypatch.setattr(inject, "TILE", 16)
    monkeypatch.setattr(inject, "TILES", 3)
    monkeypatch.setattr(inject, "PIECES", 2)
    r = random.Random(21)
    genome = {("s", "c1"): "".join(r.choice("ACGTACGTACGTNR") for _ in range(200)), ("s", "c2"): "".join(r.choice("ACGT") for _ in range(13)), ("t", "c1"): "".join(r.choice("ACGT") for _ in range(64)), ("t", "e"): ""}
    refs = spark.createDataFrame([(s, c, x) for (s, c), x in genome.items()], "species string, contig string, seq string")
    rows, aln = [], []
    for i in range(60):
        s, c = r.choice(list(genome))
        rows.append((s, f"r{i}", "".join(r.choice("ACGTN") for _ in range(r.choice([0, 1, 9, 10, 11, 30, 70]))) if i % 20 else None))
        if i % 6:
            aln.append((s, f"r{i}", c if i % 7 else "gone", r.randrange(max(1, len(genome[s, c]))), "+", 1, 1))
    reads = spark.createDataFrame(rows, "species string, read_name string, seq string")
    al = spark.createDataFrame(aln, "species string, read_name string, ref_name string, ref_start long, ref_strand string, ref_src_size long, ord long")
    marks = train.marks(refs, MOTIFS, ["species", "contig"])
    old = inject.mapped_bases(inject.mapped(reads, al, refs).where("length(contig_seq) > 0"), marks, circular).collect()
    new = inject.placed_bases(inject.placed(reads, al, refs), inject.tiles(refs, marks, circular), circular).collect()
    key = lambda x: (x.species, x.read_name, x.pos)
    a, b = ({key(x): (x.kmer if not x.is_n else None, x.meth_id if circular or not x.is_n else 0, x.is_n) for x in t} for t in (old, new))
    if not circular:  # marks under windows with an N, which are defaults anyway
        b = {k: (x[0], x[1] if not x[2] else 0, x[2]) for k, x in b.items()}
    assert a == b and len(new) == len(a) > 300


def test_commands_over_lists_and_flags_that_act(spark, tmp_path, capsys):
    from pulsegrid import cli

    files.register(spark)
    r = random.Random(5)
    genome = "".join(r.choice("ACGT") for _ in range(300)) + "CACAG" * 4
    for sp in ("spa", "spb"):
        sub = tmp_path / "meta" / sp
        sub.mkdir(parents=True)
        (sub / f"{sp}.fq").write_text("".join(f"@{sp}_{i}\n{genome[i : i + 60]}\n+\n{'I' * 60}\n" for i in range(0, 260, 20)))
        (sub / f"{sp}.maf").write_text("".join(f"a\ns c {i} 60 + 320 A\ns {sp}_{i} 0 60 + 60 A\n\n" for i in range(0, 260, 20)))
        (sub / f"{sp}.fna").write_text(f">c\n{genome}\n")
        (sub / "m.csv").write_text("motifString,centerPos,modificationType,fraction,nDetected\nCACAG,3,m6A,1,20\n")
    bam = str(tmp_path / "one.bam")
    reads = spark.createDataFrame([("x", genome, [50] * len(genome), [20] * len(genome)), ("y", None, None, None)], "read_name string, seq string, fi array<int>, fp array<int>")
    reads.coalesce(1).write.format("bam").mode("overwrite").option("single", "true").save(bam)
    t = str(tmp_path / "t.parquet")
    cli.main(["dictionary", "train", bam, "m6A,CACAG,3", t])
    both = spark.read.parquet(t).where("meth_id = 1").agg(F.sum("n")).first()[0]
    cli.main(["dictionary", "train", bam, "m6A,CACAG,3", str(tmp_path / "f.parquet"), "--no-revcomp", "--no-fuzznuc"])
    assert 0 < spark.read.parquet(str(tmp_path / "f.parquet")).where("meth_id = 1").agg(F.sum("n")).first()[0] <= both

    # the reverse strand's marks, and with them other signals, only without the flag
    sub = tmp_path / "meta" / "spa"
    (tmp_path / "jobs").write_text(f"{sub}/spa.fq|{sub}/spa.maf|{sub}/spa.fna|{t}|m6A,CTGTG,1\n\n|x|x|x|x\n")
    cli.main(["dictionary", "inject-list", str(tmp_path / "jobs"), str(tmp_path / "a")])
    cli.main(["dictionary", "inject-list", str(tmp_path / "jobs"), str(tmp_path / "b"), "--no-revcomp"])
    a, b = ({x[0]: x[4] for x in files.bam(str(tmp_path / d / "spa.bam"))} for d in "ab")
    assert list(a) == [f"spa_{i}" for i in range(0, 260, 20)] and a != b
    with pytest.raises(SystemExit, match="no motifs"):
        cli.main(["dictionary", "inject", str(sub), t, str(sub / "m.csv"), str(tmp_path / "c"), "--min-detected", "21"])

    pool = str(tmp_path / "pool.bam")
    for _ in range(2):
        cli.main(["dictionary", "metagenome", str(tmp_path / "meta"), t, pool, "--keep-species"])
    names = [(x[0], x[8]) for x in files.bam(pool)]
    assert names == [(f"{s}_{i}", s) for s in ("spa", "spb") for i in range(0, 260, 20)]
    assert len(list(files.bam(str(tmp_path / "spa.bam")))) == 13 and len(list(files.bam(str(tmp_path / "spb.bam")))) == 13

    (tmp_path / "bad.bam").write_bytes(b"no such thing")
    (tmp_path / "list").write_text(f"{bam}\n{tmp_path}/bad.bam\n{tmp_path}/gone.bam\n")
    capsys.readouterr()
    cli.main(["stats", str(tmp_path / "list"), str(tmp_path / "stats")])
    said = capsys.readouterr().out
    assert "skipped bad:" in said and "skipped gone:" in said
    got = spark.read.csv(str(tmp_path / "stats"), header=True).collect()
    assert [(x.strain, float(x.mean_ipd), float(x.std_ipd), float(x.mean_pw)) for x in got] == [("one", 50.0, 0.0, 20.0)]
    (tmp_path / "three").write_text(f"{tmp_path}/gone.bam\n{bam}\n{pool}\n")
    cli.main(["dump", str(tmp_path / "three")])
    lines = capsys.readouterr().out.strip().split("\n")
    assert lines[0].split("\t") == ["READ_NAME", "SEQUENCE", "FI_TAG", "RI_TAG", "FP_TAG", "RP_TAG"] and len(lines) == 2
    assert lines[1].split("\t") == ["x", genome, str([50] * len(genome)), "None", str([20] * len(genome)), "None"]
