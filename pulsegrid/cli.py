"""Command line: prepare, motifs, rebase, dictionary (train, merge, inject, inject-list, metagenome, analyze), cgan (extract, merge, train, generate), stats, dump."""

from __future__ import annotations

import argparse
import difflib
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators import inject, motifs, prepare, train
from pulsegrid.sources import files

COMMANDS = ["prepare", "motifs", "rebase", "dictionary", "cgan", "stats", "dump"]


def session() -> SparkSession:
    spark = SparkSession.builder.appName("pulsegrid").getOrCreate()
    files.register(spark)
    return spark


def _need(text: str) -> str:
    if not text:
        raise SystemExit("no motifs")
    return text


def _write_lines(path: str, lines: list[str]) -> None:
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def cmd_prepare(a) -> None:
    with open(a.input) as f:
        lines = f.readlines()
    kept = prepare.prepared(session(), lines, a.min_fraction, a.min_detected)
    _write_lines(a.output, [x for p in kept for x in p])
    print(f"{len(kept)} of {len(prepare.pairs(lines))} pairs kept")


def cmd_motifs(a) -> None:
    print(motifs.load(session(), a.source, a.min_fraction, a.min_detected))


def cmd_rebase(a) -> None:
    if a.action == "parse":
        with open(a.source) as f:
            print(motifs.parse_rebase(f.read().split("\n")))
        return
    spark = session()
    rows = motifs.patterns(motifs.parse(spark.createDataFrame([(motifs.load(spark, a.source),)], "motifs string")).where("strand = '+'")).orderBy("ord").collect()
    _write_lines(a.output, [x for r in rows for x in (">" + r["name"], r["motif"])])


def compiled(spark: SparkSession, a) -> list:
    return motifs.compile_motifs(_need(motifs.load(spark, a.motifs, a.min_fraction, a.min_detected)), not a.no_revcomp)


def cmd_train(a) -> None:
    spark = session()
    train.moments(spark.read.format("bam").load(a.bam), compiled(spark, a), scan_whole=a.scan_whole).write.mode("overwrite").parquet(a.output)


def cmd_merge(a) -> None:
    train.merge(session().read.parquet(*a.inputs)).write.mode("overwrite").parquet(a.output)


def cmd_analyze(a) -> None:
    table = session().read.parquet(a.table)
    names = {v: k for k, v in __import__("pulsegrid.functions.kmer", fromlist=["x"]).METH_IDS.items()}
    for r in train.coverage(table).orderBy("meth_id").collect() + train.coverage_combined(table).collect():
        d = r.asDict()
        name = names.get(d.get("meth_id"), "all methylated")
        print(f"{name}: {d['entries']} entries ({d['pct']:.4f} %), observations mean {d['mean_n'] or 0:.2f}, median {d['median_n'] or 0:g}, least {d['min_n'] or 0}, most {d['max_n'] or 0}, total {d['total_n'] or 0}")


def species_inputs(spark: SparkSession, sets, resolve, both_strands: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Reads, alignments, contigs and marks of all sets, species as a column."""
    tables: list[list[DataFrame]] = [[], [], [], [], []]
    for fq, maf, ref, species in sets:
        own = motifs.compile_motifs(_need(resolve(species, fq)), both_strands)
        at = F.lit(species).alias("species")
        r = spark.read.format("fastq").load(fq).select(at, "read_name", "seq", "qual", "ord")
        # a later contig of the same name replaces an earlier one
        c = spark.read.format("fasta").load(ref).groupBy("contig").agg(F.max_by("seq", "ord").alias("seq")).select(at, "contig", "seq")
        m = spark.read.format("maf").load(maf).select(at, "read_name", "ref_name", "ref_start", "ref_strand", "ref_src_size", "ord")
        for t, x in zip(tables, (r, m, c, train.marks(c, own, ["species", "contig"]), train.marks(r, own, ["species", "read_name"])), strict=True):
            t.append(x)
    out = []
    for t in tables:
        u = t[0]
        for x in t[1:]:
            u = u.unionByName(x)
        out.append(u)
    return tuple(out)


def _signals(spark, a, sets, resolve) -> DataFrame:
    r, m, c, cm, rm = species_inputs(spark, sets, resolve, not a.no_revcomp)
    if a.command == "cgan":
        from pulsegrid.gan import infer, model

        j = inject.placed(r, m, c)
        bases = inject.placed_bases(j, inject.tiles(c, cm, not a.linear), not a.linear).unionByName(inject.unmapped_bases(j, rm))
        bases = bases.withColumn("kmer", F.when(~F.col("is_n"), F.col("kmer"))).drop("is_n")
        return inject.assembled(infer.generate(bases, model.load(a.checkpoint)[0], a.seed, batch=max(1, a.batch_reads) * 16), r)
    return inject.inject(r, m, c, cm, rm, spark.read.parquet(a.table), not a.linear, a.seed)


def _sink(out: DataFrame, path: str, groups: list[str] | None = None, order: str = "unknown", single: bool = False) -> None:
    """Writes Parquet, a folder of BAM files, or one BAM file; what a former run wrote there is replaced."""
    if path.endswith(".parquet"):
        out.write.mode("overwrite").parquet(path)
    else:
        w = out.withColumn("flag", F.lit(4)).write.format("bam").mode("overwrite").option("order", order).option("single", str(single).lower())
        (w.option("groups", ",".join(groups)) if groups else w).save(path)


def cmd_inject(a) -> None:
    spark = session()
    sets = prepare.genome_sets(a.input) if os.path.isdir(a.input) else [(a.input, a.maf, a.reference, prepare._species(os.path.basename(a.input)))]
    if not sets:
        raise SystemExit("no genome sets")
    out = _signals(spark, a, sets, lambda s, _: motifs.species_motifs(spark, a.motifs, s, a.min_fraction, a.min_detected))
    for *_, species in sets:
        _sink(out.where(F.col("species") == species).orderBy("ord"), os.path.join(a.output, species + (".parquet" if a.parquet else "")))


def cmd_inject_list(a) -> None:
    """A job per line of a config: reads|alignment|reference|table|motifs; one BAM file each, named like the reads."""
    spark = session()
    for fq, maf, ref, table, source in prepare.inject_jobs(spark, a.config):
        species = prepare._species(os.path.basename(fq))
        a.table = table
        out = _signals(spark, a, [(fq, maf, ref, species)], lambda s, _, source=source: motifs.load(spark, source, a.min_fraction, a.min_detected))
        _sink(out.orderBy("ord"), os.path.join(a.output, species + ".bam"), single=True)
        print(f"{species}: written")


def cmd_metagenome(a) -> None:
    """One pooled BAM file in name order, with a read group per species."""
    spark = session()
    found = prepare.metagenome_sets(a.input)
    tables = {s: csv for *_, csv, s in found}
    out = _signals(spark, a, [(f, m, r, s) for f, m, r, _, s in found], lambda s, _: motifs.load(spark, tables[s], a.min_fraction, a.min_detected))
    pooled = out.withColumn("rg", F.col("species")).orderBy(inject.natural_key("read_name"), "species")
    _sink(pooled, a.output, sorted(tables), "queryname", single=True)
    if a.keep_species:
        for species in sorted(tables):
            own = out.where(F.col("species") == species).withColumn("rg", F.col("species")).orderBy("ord")
            _sink(own, os.path.join(os.path.dirname(a.output) or ".", species + ".bam"), [species], single=True)


def cmd_extract(a) -> None:
    spark = session()
    r = spark.read.format("bam").load(a.bam)
    rows = train.samples(r, compiled(spark, a), ["file", "ord"])
    key = F.md5(F.concat_ws("|", "file", F.col("ord").cast("string"), F.col("pos").cast("string")))
    train.cap(rows, a.max_samples, key).withColumn("key", key).select("kmer", "meth_id", "ipd", "pw", "key").write.mode("overwrite").parquet(a.output)


def cmd_cgan_merge(a) -> None:
    rows = train.cap(session().read.parquet(*a.inputs), a.max_samples, F.col("key"))
    rows.write.mode("overwrite").parquet(a.output)


def cmd_cgan_train(a) -> None:
    from pulsegrid.gan import train as gan

    print(gan.fit(session().read.parquet(a.samples), a.output, a.epochs, a.batch_size, a.lr_g, a.lr_d, a.noise_dim, a.kmer_embed_dim, a.n_critic, a.lambda_gp, a.resume))


def cmd_stats(a) -> None:
    """Statistics per strain; a file that cannot be read is reported and left out."""
    listed = not os.path.isdir(a.bam) and not a.bam.endswith(".bam")
    r = session().read.format("bam").option("errors", "rows").load("@" + a.bam if listed else a.bam)
    r = r.withColumn("strain", F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.bam$", ""))
    bad = r.where("error is not null").groupBy("strain").agg(F.min("error").alias("error"))
    rows = bad.orderBy("strain").collect()  # a row per file at most
    for x in rows:
        print(f"skipped {x['strain']}: {x['error']}")
    train.strain_stats(r.where(~F.col("strain").isin([x["strain"] for x in rows]))).orderBy("strain").coalesce(1).write.mode("overwrite").csv(a.output, header=True)


def cmd_dump(a) -> None:
    """Reads with a sequence and their four tags of the first two listed BAM files; files that are not there are passed."""
    spark = session()
    with open(a.list) as f:
        listed = [x.strip() for x in f.readlines()[:2]]
    names = ["fi", "ri", "fp", "rp"]
    print("\t".join(["READ_NAME", "SEQUENCE", *[f"{n.upper()}_TAG" for n in names]]))
    for path in (x for x in listed if x and os.path.exists(x)):
        text = lambda c: F.coalesce(F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]")), F.lit("None"))
        r = spark.read.format("bam").load(path).where("length(seq) > 0").orderBy("ord")
        for x in r.select(F.concat_ws("\t", "read_name", "seq", *map(text, names)).alias("line")).toLocalIterator():
            print(x["line"])


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("pulsegrid", description=__doc__, epilog="--device is accepted and changes nothing: networks run on the executors' processors. --batch-reads bounds the rows of an inference step (16 a read).")
    sub = p.add_subparsers(dest="command", required=True)

    def command(where, name, run, *args, motif=False, **more):
        c = where.add_parser(name)
        for x in args:
            c.add_argument(x, **({"nargs": "+"} if x == "inputs" else {}))
        if motif:
            c.add_argument("--min-fraction", type=float, default=motifs.MIN_FRACTION)
            c.add_argument("--min-detected", type=int, default=motifs.MIN_DETECTED)
            c.add_argument("--no-revcomp", action="store_true")
            c.add_argument("--no-fuzznuc", action="store_true", help="changes nothing: references are always scanned by the engine itself")
        for k, v in more.items():
            c.add_argument("--" + k.replace("_", "-"), **({"action": "store_true"} if v is False else {"default": v, "type": type(v) if v is not None else str}))
        c.set_defaults(run=run)
        return c

    command(sub, "prepare", cmd_prepare, "input", "output", motif=True)
    command(sub, "motifs", cmd_motifs, "source", motif=True)
    c = command(sub, "rebase", cmd_rebase, "action", "source")
    c.add_argument("output", nargs="?")
    command(sub, "stats", cmd_stats, "bam", "output")
    command(sub, "dump", cmd_dump, "list")
    d = sub.add_parser("dictionary").add_subparsers(dest="action", required=True)
    command(d, "train", cmd_train, "bam", "motifs", "output", motif=True, scan_whole=False)
    command(d, "merge", cmd_merge, "inputs", "output")
    command(d, "analyze", cmd_analyze, "table")
    command(d, "inject", cmd_inject, "input", "table", "motifs", "output", motif=True, maf=None, reference=None, linear=False, parquet=False, seed=0)
    command(d, "inject-list", cmd_inject_list, "config", "output", motif=True, linear=False, seed=0)
    command(d, "metagenome", cmd_metagenome, "input", "table", "output", motif=True, linear=False, seed=0, keep_species=False)
    g = sub.add_parser("cgan").add_subparsers(dest="action", required=True)
    command(g, "extract", cmd_extract, "bam", "motifs", "output", motif=True, max_samples=10_000)
    command(g, "merge", cmd_cgan_merge, "inputs", "output", max_samples=50_000)
    command(g, "train", cmd_cgan_train, "samples", "output", epochs=100, batch_size=4096, lr_g=1e-4, lr_d=1e-4, noise_dim=32, kmer_embed_dim=64, n_critic=5, lambda_gp=10.0, resume=None, device="cpu")
    command(g, "generate", cmd_inject, "input", "checkpoint", "motifs", "output", motif=True, maf=None, reference=None, linear=False, parquet=False, seed=0, batch_reads=1000, device="cpu")
    return p


def main(argv: list[str] | None = None) -> None:
    argv = sys.argv[1:] if argv is None else argv
    if argv and argv[0][0] != "-" and argv[0] not in COMMANDS:
        near = difflib.get_close_matches(argv[0], COMMANDS, 1, 0.6)
        raise SystemExit(f"unknown command {argv[0]}" + (f"; did you mean {near[0]}?" if near else ""))
    a = parser().parse_args(argv)
    a.run(a)
