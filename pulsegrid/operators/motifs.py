"""Motif definitions: parsing from strings, tables and enzyme databases, and scanning."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.functions.kmer import METH_IDS, iupac_to_regex, revcomp, reverse_complement

MIN_FRACTION, MIN_DETECTED = 0.40, 20
MODIFIED = {"A": "m6A", "C": "m4C"}
#: Modification codes of the enzyme database (two-column form, record form).
CODES = {6: "m6A", 5: "m5C", 4: "m4C"}
TYPE_NAMES = {"6mA": "m6A", "5mC": "m5C", "N4mC": "m4C"}


@dataclass(frozen=True)
class Motif:
    ord: int
    motif: str
    meth_id: int
    offset: int

    @property
    def regex(self) -> str:
        return iupac_to_regex(self.motif)


def compile_motifs(text: str, both_strands: bool = True) -> list[Motif]:
    """Motifs in order; entries without a comma are skipped and unknown types mark 0, which erases earlier marks."""
    out: list[Motif] = []
    for entry in text.split(";"):
        f = [x.strip() for x in entry.strip().split(",")]
        if len(f) < 3:
            continue
        meth, seq, pos = METH_IDS.get(f[0], 0), f[1], int(f[2])
        out.append(Motif(len(out), seq, meth, pos))
        if both_strands:
            out.append(Motif(len(out), revcomp(seq), meth, len(seq) - 1 - pos))
    return out


def parse(strings: DataFrame, column: str = "motifs") -> DataFrame:
    """Explodes motif strings: the other columns and ord, mod_type, motif, meth_id, pos, strand; forward, then reverse complement."""
    e = strings.select(*[c for c in strings.columns if c != column], F.posexplode(F.split(F.col(column), ";")).alias("i", "entry"))
    f = F.split(F.trim("entry"), ",")
    e = e.where(F.size(f) >= 3).withColumn("mod_type", F.trim(f[0])).withColumn("fwd", F.trim(f[1])).withColumn("p", F.trim(f[2]).cast("int"))
    meth = F.lit(0)
    for name, k in METH_IDS.items():
        meth = F.when(F.col("mod_type") == name, k).otherwise(meth)
    strands = F.array(
        F.struct(F.lit("+").alias("strand"), F.col("fwd").alias("motif"), F.col("p").alias("pos")),
        F.struct(F.lit("-").alias("strand"), reverse_complement(F.col("fwd")).alias("motif"), (F.length("fwd") - 1 - F.col("p")).alias("pos")),
    )
    keep = [c for c in strings.columns if c != column]
    e = e.withColumn("meth_id", meth).select(*keep, "i", "mod_type", "meth_id", F.posexplode(strands).alias("k", "s"))
    return e.select(*keep, (2 * F.col("i") + F.col("k")).alias("ord"), "mod_type", "meth_id", "s.strand", "s.motif", "s.pos")


def quality(rows: DataFrame, fraction: float = MIN_FRACTION, detected: int = MIN_DETECTED) -> DataFrame:
    return rows.where((F.col("fraction") >= fraction) & (F.col("nDetected") >= detected))


def resolve(rows: DataFrame) -> DataFrame:
    """Rows whose type is known, with ``mod_type``; modified_base takes its type from the base at centerPos (A, C), else goes."""
    base = F.upper(F.substring("motifString", F.col("centerPos") + 1, F.lit(1)))
    inside = (F.col("centerPos") >= 0) & (F.col("centerPos") < F.length("motifString"))
    kind = F.when(F.col("modificationType") == "modified_base", F.when(inside & (base == "A"), "m6A").when(inside & (base == "C"), "m4C")).otherwise(F.col("modificationType"))
    return rows.withColumn("mod_type", kind).where(F.col("mod_type").isin(list(METH_IDS)))


def _g(x: float) -> str:
    return f"{x:.6g}"


def read_csv(spark: SparkSession, path: str, fraction: float = MIN_FRACTION, detected: int = MIN_DETECTED) -> str:
    """The motif string of a motif table; such tables hold a few rows."""
    rows = spark.read.csv(path, header=True)
    rows = rows.select("motifString", F.col("centerPos").cast("int").alias("centerPos"), "modificationType", F.col("fraction").cast("double").alias("fraction"), F.col("nDetected").cast("int").alias("nDetected"))
    kept = resolve(quality(rows, fraction, detected)).coalesce(1).collect()
    return ";".join(f"{r.mod_type},{r.motifString},{r.centerPos},{r.nDetected},{_g(r.fraction)}" for r in kept)


def rebase_positions(rows: DataFrame) -> DataFrame:
    """recognition_seq, annotation -> ord, mod_type, motif, pos; X > 0 counts from the front, X < 0 from the end; X = 0, unknown codes (one digit each) and places outside go."""
    site = r"(-?\d+)\((\d)\)"
    each = rows.select("*", F.posexplode(F.regexp_extract_all("annotation", F.lit(site), F.lit(1))).alias("k", "x"))
    each = each.withColumn("code", F.element_at(F.regexp_extract_all("annotation", F.lit(site), F.lit(2)), F.col("k") + 1).cast("int")).withColumn("x", F.col("x").cast("int"))
    kind = F.lit(None).cast("string")
    for c, name in CODES.items():
        kind = F.when(F.col("code") == c, name).otherwise(kind)
    seq = F.upper("recognition_seq")
    pos = F.when(F.col("x") > 0, F.col("x") - 1).when(F.col("x") < 0, F.length(seq) + F.col("x"))
    out = each.withColumn("mod_type", kind).withColumn("motif", seq).withColumn("pos", pos)
    return out.where(F.col("mod_type").isNotNull() & (F.col("pos") >= 0) & (F.col("pos") < F.length("motif")))


def _sites(seq: str, annotation: str, pattern: str, kinds: dict[str, str]) -> Iterator[str]:
    """Motif entries of an annotation's sites, in order."""
    for x, code in re.findall(pattern, annotation):
        kind, pos = kinds.get(code), int(x) - 1 if int(x) > 0 else len(seq) - abs(int(x))
        if kind and 0 <= pos < len(seq):
            yield f"{kind},{seq},{pos}"


def parse_rebase(lines: list[str]) -> str:
    """The motif string of an enzyme database.

    Its record form if any line starts with ID, RS or MS and three spaces; a tag there
    ends at a tab or at three spaces, the last RS and MS of a record count, and a record
    whose RS or MS is missing or ``?`` goes, as does one that no ``//`` ends.  Types are
    names then, numbers are unknown.  Else two columns, where types are one digit.
    """
    out: list[str] = []
    if not any(x.startswith(("ID   ", "RS   ", "MS   ")) for x in lines):
        digits = {str(c): name for c, name in CODES.items()}
        for line in lines:
            f = line.split()
            if len(f) >= 2 and not f[0].startswith("#"):
                out += _sites(f[0].upper(), f[1], r"(-?\d+)\((\d)\)", digits)
        return ";".join(out)
    record: dict[str, str] = {}
    for line in lines:
        if line.startswith("//"):
            rs, ms = record.get("RS", ""), record.get("MS", "")
            seq = re.sub("[^ACGTRYMKSWHBVDN]", "", rs.upper())
            if rs != "?" and ms != "?" and seq:
                out += _sites(seq, ms, r"(-?\d+)\((\w+)\)", TYPE_NAMES)
            record = {}
            continue
        tag, mark, value = line.partition("\t" if "\t" in line else "   ")
        if mark:
            record[tag.strip()] = value.strip()
    return ";".join(out)


def load(spark: SparkSession, source: str, fraction: float = MIN_FRACTION, detected: int = MIN_DETECTED) -> str:
    """A motif string from a .csv table, an enzyme database, or the string itself."""
    if os.path.isfile(source):
        if source.lower().endswith(".csv"):
            return read_csv(spark, source, fraction, detected)
        with open(source) as f:
            return parse_rebase([x.rstrip("\n") for x in f])
    return source


def species_motifs(spark: SparkSession, source: str, species: str, fraction: float = MIN_FRACTION, detected: int = MIN_DETECTED) -> str:
    """The motifs of a species from a ``species|motifs`` file (first match), else as ``load``."""
    if os.path.isfile(source) and not source.endswith(".csv"):
        with open(source) as f:
            for line in f:
                if line.startswith(species + "|"):
                    return line.rstrip("\n").split("|", 1)[1].strip()
    return load(spark, source, fraction, detected)


def patterns(entries: DataFrame) -> DataFrame:
    """Pattern names {type}_{motif}_{pos} and motifs, the first entry (by ord) of each name."""
    named = entries.withColumn("name", F.concat_ws("_", "mod_type", "motif", F.col("pos").cast("string")))
    w = Window.partitionBy("name").orderBy("ord")
    return named.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("name", "motif", "ord")


def decode_name(name) -> tuple:
    """Columns (meth_id, pos) of a pattern name: its first and last parts; (0, 0) where that fails."""
    parts = F.split(name, "_")
    pos = F.expr("try_cast(element_at(split(name, '_'), -1) as int)")
    ok = (F.size(parts) >= 3) & pos.isNotNull()
    meth = F.lit(0)
    for k, v in METH_IDS.items():
        meth = F.when(parts[0] == k, v).otherwise(meth)
    return F.when(ok, meth).otherwise(0), F.when(ok, pos).otherwise(0)


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """contig, start, stop, strand, attributes, ord of a fuzzy search's hits; comments, blank lines and lines of fewer than seven columns go.

    ``ord`` follows file and line order: of two hits at one place the later one counts.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.struct(F.input_file_name(), F.monotonically_increasing_id()).alias("ord"))
    f = F.split("line", "\t")
    lines = lines.where(~F.col("line").startswith("#") & (F.trim("line") != "") & (F.size(f) >= 7))
    attributes = F.when(F.size(f) > 8, F.trim(F.element_at(f, 9))).otherwise("")
    return lines.select(f[0].alias("contig"), f[3].cast("int").alias("start"), f[4].cast("int").alias("stop"), f[6].alias("strand"), attributes.alias("attributes"), "ord")


def gff_positions(hits: DataFrame, known: DataFrame) -> DataFrame:
    """contig, pos, meth_id of fuzzy-search hits, with ``ord`` if they have one; names that the patterns lack are decoded, places outside the contig go.

    The name is what follows the first ``Pattern_name=``, ``Name=`` or ``pattern=`` (in any
    case) up to a semicolon; without one the hit marks 0 at its first base.
    hits: contig, start (1-based), stop, strand, attributes, contig_len; known: name, meth_id, pos (a few per motif).
    """
    named = hits.withColumn("name", F.trim(F.regexp_extract("attributes", r"(?i)(?:Pattern_name|Name|pattern)=([^;]+)", 1)))
    meth, pos = decode_name(F.col("name"))
    joined = named.withColumn("d_meth", meth).withColumn("d_pos", pos).join(known.withColumnRenamed("pos", "k_pos").withColumnRenamed("meth_id", "k_meth"), "name", "left")
    offset, kind = F.coalesce("k_pos", "d_pos"), F.coalesce("k_meth", "d_meth")
    at = F.when(F.col("strand") == "+", F.col("start") - 1 + offset).otherwise(F.col("stop") - 1 - offset)
    placed = joined.withColumn("pos", at).withColumn("meth_id", kind).where((F.col("pos") >= 0) & (F.col("pos") < F.col("contig_len")))
    return placed.select("contig", "pos", "meth_id", *[c for c in hits.columns if c == "ord"])


def gff_marks(hits: DataFrame, contigs: DataFrame, known: DataFrame) -> DataFrame:
    """contig, pos, meth_id of every base that hits (with ``ord``) mark, the last hit of a base first; a last hit of no known type erases. Hits on contigs that are not there go."""
    sized = hits.join(contigs.select("contig", F.length("seq").alias("contig_len")), "contig")
    placed = gff_positions(sized, known)
    return placed.groupBy("contig", "pos").agg(F.max_by("meth_id", "ord").alias("meth_id")).where("meth_id <> 0")


def known_patterns(text: str) -> list[tuple[str, int, int]]:
    """(name, meth_id, pos) of each pattern name of a motif string; the first entry of a name counts."""
    out: dict[str, tuple[str, int, int]] = {}
    for entry in text.split(";"):
        f = entry.split(",")
        if len(f) >= 3:
            out.setdefault(f"{f[0]}_{f[1]}_{int(f[2])}", (f"{f[0]}_{f[1]}_{int(f[2])}", METH_IDS.get(f[0], 0), int(f[2])))
    return list(out.values())
