"""Reads, alignments, references and motif inputs derived from the driver's tables, in Spark and in SQL alike."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators.train import Packed
from pulsegrid.shared import small_batches

_LETTERS, _BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
STEP, TAIL = 64, 32  # of the SQL only: texts are cut into pieces of STEP letters and the TAIL letters behind them, as substring counts from the start of its text
CONTIG_DOCS = 64  # documents of one contig
MOTIFS = "m6A,GATC,1;m4C,CCWGG,1;m6A,CACAGGNC,4,1539,0.998054;m5C,RCCGGY,2;odd,GANTC,1;m6A,GTCANNNNNGTCG,4,925,1;nonsense"

# Rows of small inputs. Motif tables: motifString, centerPos, modificationType, fraction, nDetected.
MOTIF_ROWS = [
    ("GATC", 1, "m6A", 0.99, 2000), ("CCWGG", 1, "m4C", 0.40, 20), ("GANTC", 1, "m6A", 0.39, 500), ("RCCGGY", 2, "m5C", 0.8, 19), ("GCCGGCY", 1, "modified_base", 0.406229, 7161),
    ("CTAG", 3, "modified_base", 0.7, 50), ("CTAG", 2, "modified_base", 0.7, 50), ("TTAA", 9, "modified_base", 0.9, 90), ("ACGT", -1, "modified_base", 0.9, 90), ("AGCT", 0, "weird", 0.9, 90), ("CAGT", 0, "none", 0.9, 90),
]
REBASE_ROWS = [("GCWGC", "2(6),-1(6)"), ("gatc", "2(6)"), ("CCWGG", "0(5)"), ("RCCGGY", "3(4),9(4)"), ("ACGT", "1(7)"), ("TGCA", "?"), ("CCNGG", "-4(5)"), ("CCWGG", "2(5),-1(4)"), ("GGCC", "3(66),4(5)"), ("AGCT", "-9(6)")]
REBASE_RECORDS = [
    "ID   A|RS   GA^TC|MS   2(6mA)", "ID   B|RS   CCWGG|MS   2(N4mC),-2(5mC)", "ID   C|RS   ?|MS   1(6mA)", "ID   D|RS   gcngc|MS   2(xyz),3(4),2(5mC)", "ID   E|RS   TCGA, ?;|MS   4(6mA)", "ID   F|RS   GATC|MS   2(6)",
    "ID\tG|RS\tGTAC, 2;|MS\t3(6mA),4(N4mC)", "ID   H|RS   CCGG|RS   GGCC|MS   1(5mC)|MS   3(5mC)", "ID   I|RS   GATC", "ID   J|RS   GATC|MS   ?",
]
GFF_ROWS = [
    ("c1", 11, 14, "+", "pattern_name=m6A_GATC_1", 100), ("c1", 11, 14, "-", "Pattern_name=m6A_GATC_1;score=4", 100), ("c2", 1, 5, "-", "pattern_name=m4C_CCWGG_9", 20), ("c2", 18, 20, "+", "pattern_name=m5C_RCC_3", 20), ("c3", 7, 9, "+", "pattern_name=broken", 30),
    ("c3", 11, 14, "+", "ID=x.1;Name=m4C_CCWGG_1;note=y", 30), ("c3", 15, 18, "-", "pattern=m5C_RCCGGY_2", 30), ("c3", 20, 24, "+", "NAME= m6A_GATC_1 ;pattern=m4C_CCWGG_1", 30), ("c3", 25, 28, "+", "", 30), ("c3", 26, 29, ".", "Name=zzz_GATC_0", 30),
]
PAIRS = [("/data/s1.bam", "m6A,GATC,1"), ("/data/s2.bam", ""), ("/data/s3.bam", "m4C,CCWGG,1;m6A,GANTC,1"), ("/data/s4.bam", "/gone/motifs.csv"), ("/data/s5.bam", "motifs.csv"), ("/data/s6.bam", "sites.txt"), ("/data/s7.bam", "m6A,GATC,1,200,0.99;m5C,CC,0")]
JOBS = [("/d/a.fq.gz", "/d/a.maf.gz", "/d/a.fna", "/d/t.parquet", "m6A,GATC,2;m4C,CCWGG,1"), ("/d/b.fq", "/d/b.maf", "/d/b.fa", "/d/t.parquet", "/d/m.csv", "more"), ("", "x", "x", "x", "x"), ("/d/c.fq", "/d/c.maf")]
IUPAC_ROWS = ["GATC", "CCWGG", "RYSWKM", "BDHVN", "GANTC", "", "gat-x"]
EXCLUDED = ["src3", "src7", "src11"]
SPECIES_MOTIFS = [("en", "m6A,GATC,1"), ("de", "m4C,CCWGG,1;m6A,GANTC,1"), ("xx", "m5C,RCCGGY,2")]


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    seq = F.regexp_replace(F.translate(F.lower(F.coalesce("text", F.lit(""))), _LETTERS, _BASES), "[^ACGT]", "")
    d = d.select("doc_id", F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("read_name"), seq.alias("seq"), F.col("lang").alias("species"), F.col("source").alias("strain"))
    # (doc_id * a + i * b + c) % 256 for each i: a sequence with step b, of which eight bits stay
    signal = lambda a, b, c, m: F.expr(
        f"if(length(seq) > doc_id % {m}, transform(sequence(cast((doc_id * {a} + {c}) % 256 as int), cast((doc_id * {a} + {c}) % 256 + (length(seq) - doc_id % {m} - 1) * {b} as int), {b}), x -> x & 255), cast(array() as array<int>))"
    )
    return d.withColumn("fi", signal(31, 17, 7, 3)).withColumn("fp", signal(13, 29, 3, 2)).withColumn("ri", signal(7, 5, 1, 4)).withColumn("rp", signal(11, 3, 2, 5))


_BASE_OF = bytes(ord(_BASES[(i | 32) - 97]) if 97 <= i | 32 <= 122 and i < 128 else i for i in range(256))
_NO_LETTERS = bytes(i for i in range(256) if not (97 <= i | 32 <= 122 and i < 128))


def _letters(b: pa.RecordBatch) -> list[bytes]:
    """The bases of texts, as ``reads`` has them; lower-casing turns few letters beyond ASCII into ASCII ones."""
    return [((s or "") if (s or "").isascii() else s.lower()).encode(errors="replace").translate(_BASE_OF, _NO_LETTERS) for s in b.column("text").to_pylist()]


def _signals(b: pa.RecordBatch, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """fi and fp of texts with so many bases, as ``reads`` has them; none where there is no number."""
    doc, known = b.column("doc_id").fill_null(0).to_numpy(), b.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
    out = []
    for a, step, c, m in ((31, 17, 7, 3), (13, 29, 3, 2)):
        n = np.where(known, np.maximum(lengths - np.fmod(doc, m), 0), 0)
        off = np.concatenate(([0], np.cumsum(n)))
        first = (doc * a + c).astype(np.uint8)
        with np.errstate(over="ignore"):
            places = (np.arange(off[-1]) - np.repeat(off[:-1], n)).astype(np.uint8)
            out += [places * np.uint8(step) + np.repeat(first, n), off]
    return tuple(out)


def packed(spark: SparkSession, sf_dir: str) -> Packed:
    """``reads`` for kernels: the same letters and signals, made where they are used."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.col("lang").alias("species"), F.col("source").alias("strain"))
    return Packed(d.withColumn("text", F.col("text").cast("string")).withColumn("doc_id", F.col("doc_id").cast("long")), ("text", "doc_id"), _letters, _signals)


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, read_name, species, n) of ``reads``: their lengths without their letters."""
    src = small_batches(packed(spark, sf_dir).frame.select("doc_id", "species", "text"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("species"), pa.array([len(s) for s in _letters(b)], pa.int64())], names=["doc_id", "species", "n"])

    got = src.mapInArrow(run, f"doc_id bigint, species {src.schema['species'].dataType.simpleString()}, n bigint")
    return got.select("doc_id", F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("read_name"), "species", "n")


def contig_sizes(r: DataFrame) -> DataFrame:
    """(species, contig, size) of ``contigs``, from the lengths of its reads."""
    return r.groupBy("species", _contig().alias("contig")).agg(F.sum("n").alias("size"))


def _contig(species: str = "species") -> Column:
    return F.concat(F.lit("chr_"), F.col(species), F.lit("_"), F.floor(F.col("doc_id") / CONTIG_DOCS).cast("string"))


def contigs(r: DataFrame) -> DataFrame:
    """The reads of CONTIG_DOCS neighbouring documents of a species, one after the other: all documents lie in one, and none grows with the table."""
    g = r.groupBy("species", _contig().alias("contig")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "seq"))).alias("s"))
    return g.select("species", "contig", F.array_join(F.transform("s", lambda x: x["seq"]), "").alias("seq"))


def alignments(r: DataFrame, c: DataFrame) -> DataFrame:
    """Two lines for some reads (the last one counts), none for others, and a contig that is not there. c: of ``contigs`` or ``contig_sizes``."""
    size = F.col("size") if "size" in c.columns else F.length("seq")
    base = r.where("doc_id % 7 <> 3").withColumn("contig", _contig()).join(c.select("species", "contig", size.cast("long").alias("ref_src_size")), ["species", "contig"])
    name = F.when(F.col("doc_id") % 11 == 5, F.lit("missing")).otherwise(F.col("contig"))
    rows = base.select("species", "read_name", name.alias("ref_name"), F.pmod(F.col("doc_id") * 7919, F.col("ref_src_size")).alias("ref_start"), F.when(F.col("doc_id") % 2 == 0, "+").otherwise("-").alias("ref_strand"), "ref_src_size", F.lit(2).cast("long").alias("ord"), "doc_id")
    first = rows.where("doc_id % 13 = 0").withColumn("ref_start", F.lit(0).cast("long")).withColumn("ord", F.lit(1).cast("long"))
    return rows.unionByName(first).drop("doc_id")


def _values(rows: list[tuple], cols: str) -> str:
    lit = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({cols}))"


_SIG = "list_transform(range(0, greatest(length(seq) - doc_id % {m}, 0)), lambda i: CAST((doc_id * {a} + i * {b} + {c}) % 256 AS INTEGER))"
READS_SQL = f"""reads0 AS (SELECT doc_id, 'r' || CAST(doc_id AS VARCHAR) AS read_name, regexp_replace(translate(lower(coalesce(text, '')), '{_LETTERS}', '{_BASES}'), '[^ACGT]', '', 'g') AS seq, lang AS species, source AS strain FROM documents),
reads AS (SELECT *, {_SIG.format(a=31, b=17, c=7, m=3)} AS fi, {_SIG.format(a=13, b=29, c=3, m=2)} AS fp, {_SIG.format(a=7, b=5, c=1, m=4)} AS ri, {_SIG.format(a=11, b=3, c=2, m=5)} AS rp FROM reads0)"""


def encode_sql(s: str) -> str:
    """The number of an 11-letter string."""
    return "CAST(" + " + ".join(f"(instr('ACGT', {s}[{j + 1}]) - 1) * {4 ** (10 - j)}" for j in range(11)) + " AS INTEGER)"


def places_sql(src: str, keys: str, seq: str = "seq") -> str:
    """keys, n, p and w: the letters from place p on (TAIL at least, or all), for every place of the texts of ``src``."""
    cut = f"SELECT {keys}, length({seq}) AS n, unnest(range(0, length({seq}), {STEP})) AS base, {seq} AS s FROM {src}"
    return f"SELECT {keys}, n, base + j AS p, substring(w, CAST(j + 1 AS INTEGER), {TAIL}) AS w FROM (SELECT {keys}, n, base, w, unnest(range(0, least({STEP}, n - base))) AS j FROM (SELECT {keys}, n, base, substring(s, CAST(base + 1 AS INTEGER), {STEP + TAIL}) AS w FROM ({cut})))"


def marks_sql(places: str, keys: str, motifs: list) -> str:
    """keys, p, meth_id of every place that a motif targets (the last motif counts), from ``places_sql``'s rows."""
    one = lambda m: f"SELECT {keys}, p + {m.offset} AS p, n, {m.ord} AS ord, {m.meth_id} AS meth_id FROM {places} WHERE regexp_matches(w, '^{m.regex}')"
    return f"SELECT {keys}, p, arg_max(meth_id, ord) AS meth_id FROM ({' UNION ALL '.join(map(one, motifs))}) WHERE p >= 0 AND p < n GROUP BY {keys}, p"


def windows_sql(motifs: list) -> str:
    """reads, motif marks by position (last motif wins), and all windows with their centre's signals."""
    return f"""{READS_SQL},
eff AS (SELECT doc_id, read_name, species, strain, substring(seq, 1, least(length(seq), len(fi), len(fp))) AS seq FROM reads WHERE length(seq) >= 11),
pos AS ({places_sql('eff', 'doc_id, strain')}),
marked AS ({marks_sql('pos', 'doc_id', motifs)}),
win AS (SELECT w.doc_id, w.strain, w.p AS i, (w.doc_id * 31 + (w.p + 5) * 17 + 7) % 256 AS ipd, (w.doc_id * 13 + (w.p + 5) * 29 + 3) % 256 AS pw, {encode_sql("w.w")} AS kmer, CAST(coalesce(m.meth_id, 0) AS INTEGER) AS meth_id
  FROM pos w LEFT JOIN marked m ON m.doc_id = w.doc_id AND m.p = w.p + 5 WHERE w.p + 11 <= w.n)"""


MOMENTS_SQL = "CAST(count(*) AS BIGINT) AS n, CAST(sum(ipd) AS DOUBLE) AS sum_ipd, CAST(sum(ipd * ipd) AS DOUBLE) AS sum_ipd2, CAST(sum(pw) AS DOUBLE) AS sum_pw, CAST(sum(pw * pw) AS DOUBLE) AS sum_pw2"
REF_SQL = f"""contigs AS (SELECT species, 'chr_' || species || '_' || CAST(doc_id // {CONTIG_DOCS} AS VARCHAR) AS contig, string_agg(seq, '' ORDER BY doc_id) AS seq FROM reads GROUP BY 1, 2),
aln0 AS (SELECT r.species, r.read_name, CASE WHEN r.doc_id % 11 = 5 THEN 'missing' ELSE c.contig END AS ref_name, (r.doc_id * 7919) % length(c.seq) AS ref_start,
  CASE WHEN r.doc_id % 2 = 0 THEN '+' ELSE '-' END AS ref_strand, CAST(length(c.seq) AS BIGINT) AS ref_src_size FROM reads r JOIN contigs c ON c.species = r.species AND c.contig = 'chr_' || r.species || '_' || CAST(r.doc_id // {CONTIG_DOCS} AS VARCHAR) WHERE r.doc_id % 7 <> 3),
mapped AS (SELECT r.doc_id, r.read_name, r.species, r.seq, a.ref_name, a.ref_start, a.ref_strand, a.ref_src_size, c.seq AS contig_seq FROM reads r LEFT JOIN aln0 a ON a.species = r.species AND a.read_name = r.read_name
  LEFT JOIN contigs c ON c.species = r.species AND c.contig = a.ref_name)"""
