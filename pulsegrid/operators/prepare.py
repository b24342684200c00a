"""Preparing pair lists and discovering genome sets; file names are few, so this is driver-side Python."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators.motifs import MIN_DETECTED, MIN_FRACTION, load

FASTQ, MAF, REF = (".fq.gz", ".fastq.gz", ".fq", ".fastq"), (".maf", ".maf.gz"), (".fna", ".fasta", ".fa", ".ref", ".fna.gz", ".fasta.gz", ".fa.gz")


def pairs(lines: list[str]) -> list[tuple[str, str]]:
    """Alternating non-blank lines; an odd number is an error."""
    kept = [x.strip() for x in lines if x.strip()]
    if len(kept) % 2:
        raise SystemExit("odd number of lines: every path needs a motif source")
    return list(zip(kept[::2], kept[1::2], strict=True))


def prepared(spark: SparkSession, lines: list[str], fraction: float = MIN_FRACTION, detected: int = MIN_DETECTED) -> list[tuple[str, str]]:
    """(path, motif string) of the pairs whose motif source exists and yields motifs, in order."""
    out = []
    for path, source in pairs(lines):
        is_path = os.sep in source or source.endswith((".csv", ".txt"))
        if is_path and not os.path.isfile(source):
            print(f"skipped {path}: no {source}")
            continue
        found = load(spark, source, fraction, detected)
        if found:
            out.append((path, found))
    return out


def inject_jobs(spark: SparkSession, path: str) -> list[tuple[str, str, str, str, str]]:
    """(reads, alignment, reference, table, motifs) of each line of a pipe-delimited config; lines without reads go, and what stands behind the fifth field. Jobs are few."""
    lines = spark.read.text(path).select(F.split("value", r"\|").alias("f")).where((F.size("f") >= 5) & (F.trim(F.col("f")[0]) != ""))
    return [tuple(r) for r in lines.select(*[F.trim(F.col("f")[i]) for i in range(5)]).collect()]


def _first(folder: str, endings: tuple[str, ...]) -> str | None:
    names = sorted(os.listdir(folder))
    return next((os.path.join(folder, n) for e in endings for n in names if n.endswith(e)), None)


def _species(name: str) -> str:
    for e in FASTQ:
        if name.endswith(e):
            return name[: -len(e)]
    return name


def genome_sets(folder: str) -> list[tuple[str, str, str, str]]:
    """(fastq, maf, reference, species) of a flat folder (files matched by base name) or of one folder per species; incomplete sets are skipped."""
    names = sorted(os.listdir(folder))
    out = []
    flat = [n for n in names if n.endswith(FASTQ)]
    for n in flat:
        s = _species(n)
        own = lambda ends, s=s: next((os.path.join(folder, s + e) for e in ends if s + e in names), None)
        out.append((os.path.join(folder, n), own(MAF), own(REF), s))
    if not flat:
        for n in names:
            sub = os.path.join(folder, n)
            if os.path.isdir(sub) and (fq := _first(sub, FASTQ)):
                out.append((fq, _first(sub, MAF), _first(sub, REF), n))
    for fq, maf, ref, _ in out:
        if not (maf and ref):
            print(f"skipped {fq}: no {'alignment' if not maf else 'reference'}")
    return [x for x in out if x[1] and x[2]]


def metagenome_sets(root: str) -> list[tuple[str, str, str, str, str]]:
    """(fastq, maf, reference, motif table, species) of every subfolder; any incomplete one ends the run."""
    out = []
    for n in sorted(x for x in os.listdir(root) if os.path.isdir(os.path.join(root, x))):
        sub = os.path.join(root, n)
        got = [_first(sub, e) for e in (FASTQ, MAF, REF, (".csv",))]
        if None in got:
            raise SystemExit(f"{n}: a read, alignment, reference or motif file is missing")
        out.append((*got, n))
    if not out:
        raise SystemExit("no species folders")
    return out
