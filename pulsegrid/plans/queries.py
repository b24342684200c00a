"""All queries over the driver's tables and the SQL that answers alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import kmer, signal
from pulsegrid.operators import inject, motifs, train
from pulsegrid.plans import fixtures as X
from pulsegrid.shared import numbered, scratch_path
from pulsegrid.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
COMPILED = motifs.compile_motifs(X.MOTIFS)
FORWARD = motifs.compile_motifs(X.MOTIFS, both_strands=False)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark, sf):
    return train.moments(X.packed(spark, sf), COMPILED)


_W, _WF = X.windows_sql(COMPILED), X.windows_sql(FORWARD)
_DICT = f"{_W}, dict AS (SELECT kmer, meth_id, {X.MOMENTS_SQL} FROM win GROUP BY kmer, meth_id)"


# ---------------------------------------------------------------- scalars


@query(f"WITH {X.READS_SQL} SELECT doc_id, {X.encode_sql('substring(seq, 1, 11)')} AS kmer FROM reads WHERE length(seq) >= 11")
def kmer_encode(spark, sf):
    return X.reads(spark, sf).where("length(seq) >= 11").select("doc_id", kmer.encode(F.substring("seq", 1, 11)).alias("kmer"))


@query(f"WITH {X.READS_SQL} SELECT doc_id, substring(seq, 1, 11) AS kmer_seq FROM reads WHERE length(seq) >= 11")
def kmer_decode(spark, sf):
    return kmer_encode(spark, sf).select("doc_id", kmer.decode(F.col("kmer")).alias("kmer_seq"))


@query(f"WITH {X.READS_SQL}, w AS ({X.places_sql('reads', 'doc_id')}) SELECT {X.encode_sql('w')} AS kmer, CAST(count(*) AS BIGINT) AS n FROM w WHERE p + 11 <= n GROUP BY 1")
def kmer_sliding(spark, sf):
    return train.kmers(X.reads(spark, sf))


@query(f"WITH {X.READS_SQL} SELECT doc_id, reverse(translate(seq, 'ACGTYRKMBVDH', 'TGCARYMKVBHD')) AS rc FROM reads")
def revcomp(spark, sf):
    return X.reads(spark, sf).select("doc_id", kmer.reverse_complement(F.col("seq")).alias("rc"))


_ONE = f"(SELECT '{X.MOTIFS}' AS motifs)"
_METH = "CASE {} WHEN 'm6A' THEN 1 WHEN 'm4C' THEN 2 WHEN 'm5C' THEN 3 ELSE 0 END"


@query(
    f"""WITH e AS (SELECT i, string_split(trim(string_split(motifs, ';')[i + 1]), ',') AS f FROM (SELECT motifs, unnest(range(0, len(string_split(motifs, ';')))) AS i FROM {_ONE})),
    g AS (SELECT CAST(i AS INTEGER) AS i, f[1] AS mod_type, f[2] AS m, CAST(f[3] AS INTEGER) AS p FROM e WHERE len(f) >= 3)
    SELECT 2 * i AS ord, mod_type, {_METH.format('mod_type')} AS meth_id, '+' AS strand, m AS motif, p AS pos FROM g
    UNION ALL SELECT 2 * i + 1, mod_type, {_METH.format('mod_type')}, '-', reverse(translate(m, 'ACGTYRKMBVDH', 'TGCARYMKVBHD')), CAST(length(m) - 1 - p AS INTEGER) FROM g"""
)
def motif_parse(spark, sf):
    return motifs.parse(spark.createDataFrame([(X.MOTIFS,)], "motifs string"))


def _rows(spark):
    return spark.createDataFrame(X.MOTIF_ROWS, "motifString string, centerPos int, modificationType string, fraction double, nDetected int")


_ROWS = X._values(X.MOTIF_ROWS, "motifString, centerPos, modificationType, fraction, nDetected")


@query(f"SELECT motifString, CAST(centerPos AS INTEGER) AS centerPos, modificationType, CAST(fraction AS DOUBLE) AS fraction, CAST(nDetected AS INTEGER) AS nDetected FROM {_ROWS} WHERE fraction >= 0.40 AND nDetected >= 20")
def motif_quality_filter(spark, sf):
    return motifs.quality(_rows(spark))


@query(
    f"""SELECT motifString, CAST(centerPos AS INTEGER) AS centerPos, mod_type FROM (SELECT *, CASE WHEN modificationType <> 'modified_base' THEN modificationType WHEN centerPos < 0 OR centerPos >= length(motifString) THEN NULL
    WHEN upper(substring(motifString, centerPos + 1, 1)) = 'A' THEN 'm6A' WHEN upper(substring(motifString, centerPos + 1, 1)) = 'C' THEN 'm4C' END AS mod_type FROM {_ROWS}) WHERE mod_type IN ('none', 'm6A', 'm4C', 'm5C')"""
)
def modified_base_resolve(spark, sf):
    return motifs.resolve(_rows(spark)).select("motifString", "centerPos", "mod_type")


_CODE = "CASE code WHEN '6' THEN 'm6A' WHEN '5' THEN 'm5C' WHEN '4' THEN 'm4C' WHEN '6mA' THEN 'm6A' WHEN '5mC' THEN 'm5C' WHEN 'N4mC' THEN 'm4C' END"
# {code} matches one code: a digit in the two-column form, a name in the record form
_REBASE = """SELECT mod_type, motif, CAST(pos AS INTEGER) AS pos FROM (SELECT {kind} AS mod_type, motif,
CASE WHEN x > 0 THEN x - 1 WHEN x < 0 THEN length(motif) + x END AS pos FROM (SELECT upper(s) AS motif, CAST(unnest(regexp_extract_all(a, '(-?\\d+)\\({code}\\)', 1)) AS INTEGER) AS x, unnest(regexp_extract_all(a, '-?\\d+\\(({code})\\)', 1)) AS code FROM {src}))
WHERE mod_type IS NOT NULL AND pos >= 0 AND pos < length(motif)"""


@query(_REBASE.format(src=X._values(X.REBASE_ROWS, "s, a"), code="\\d", kind=_CODE))
def rebase_simple_parse(spark, sf):
    return motifs.rebase_positions(spark.createDataFrame(X.REBASE_ROWS, "recognition_seq string, annotation string")).select("mod_type", "motif", "pos")


# tag and value of a record's lines: cut at a tab, else at three spaces; the last RS and the last MS count
_FIELD = "list_filter(list_transform(string_split(r, '|'), lambda x: CASE WHEN contains(x, chr(9)) THEN [trim(string_split(x, chr(9))[1]), trim(string_split(x, chr(9))[2])] ELSE [trim(string_split(x, '   ')[1]), trim(string_split(x, '   ')[2])] END), lambda f: f[1] = '{}')[-1][2]"


@query(
    _REBASE.format(
        src=f"(SELECT regexp_replace(upper(rs), '[^ACGTRYMKSWHBVDN]', '', 'g') AS s, ms AS a FROM (SELECT {_FIELD.format('RS')} AS rs, {_FIELD.format('MS')} AS ms FROM {X._values([(r,) for r in X.REBASE_RECORDS], 'r')}) WHERE rs <> '?' AND ms <> '?')",
        code="\\w+", kind=_CODE.replace("WHEN '6' THEN 'm6A' WHEN '5' THEN 'm5C' WHEN '4' THEN 'm4C' ", ""),
    )
)
def rebase_withrefm_parse(spark, sf):
    text = "\n".join(r.replace("|", "\n") + "\n//" for r in X.REBASE_RECORDS)
    got = motifs.parse_rebase(text.split("\n"))
    return motifs.parse(spark.createDataFrame([(got,)], "motifs string")).where("strand = '+'").select("mod_type", "motif", "pos")


@query(f"""WITH e AS (SELECT i, string_split(trim(string_split(motifs, ';')[i + 1]), ',') AS f FROM (SELECT motifs, unnest(range(0, len(string_split(motifs, ';')))) AS i FROM (SELECT '{X.MOTIFS};m6A,GATC,1;m4C,GATC,1' AS motifs))),
    g AS (SELECT f[1] || '_' || f[2] || '_' || f[3] AS name, f[2] AS motif, CAST(2 * i AS INTEGER) AS ord FROM e WHERE len(f) >= 3)
    SELECT name, arg_min(motif, ord) AS motif, min(ord) AS ord FROM g GROUP BY name""")
def pattern_dedup(spark, sf):
    return motifs.patterns(motifs.parse(spark.createDataFrame([(X.MOTIFS + ";m6A,GATC,1;m4C,GATC,1",)], "motifs string")).where("strand = '+'"))


_PATTERNS = [("m6A_GATC_1",), ("m4C_CCWGG_x",), ("m5C_A_B_12",), ("zzz_GATC_3",), ("broken",), ("",)]


@query(
    f"""SELECT name, CASE WHEN ok THEN {_METH.format("string_split(name, '_')[1]")} ELSE 0 END AS meth_id, CASE WHEN ok THEN try_cast(string_split(name, '_')[-1] AS INTEGER) ELSE 0 END AS pos
    FROM (SELECT name, len(string_split(name, '_')) >= 3 AND try_cast(string_split(name, '_')[-1] AS INTEGER) IS NOT NULL AS ok FROM {X._values(_PATTERNS, 'name')})"""
)
def pattern_name_decode(spark, sf):
    d = spark.createDataFrame(_PATTERNS, "name string")
    meth, pos = motifs.decode_name(F.col("name"))
    return d.select("name", meth.alias("meth_id"), pos.alias("pos"))


@query(
    f"""WITH h AS (SELECT *, trim(regexp_extract(attributes, '(?:pattern_name|name|pattern)=([^;]+)', 1, 'i')) AS name FROM {X._values(X.GFF_ROWS, 'contig, start, stop, strand, attributes, contig_len')}),
    d AS (SELECT *, len(string_split(name, '_')) >= 3 AND try_cast(string_split(name, '_')[-1] AS INTEGER) IS NOT NULL AS ok FROM h),
    p AS (SELECT *, CASE WHEN ok THEN {_METH.format("string_split(name, '_')[1]")} ELSE 0 END AS meth_id, CASE WHEN ok THEN try_cast(string_split(name, '_')[-1] AS INTEGER) ELSE 0 END AS o FROM d),
    q AS (SELECT contig, CASE WHEN strand = '+' THEN start - 1 + o ELSE stop - 1 - o END AS pos, meth_id, contig_len FROM p)
    SELECT contig, CAST(pos AS INTEGER) AS pos, meth_id FROM q WHERE pos >= 0 AND pos < contig_len"""
)
def gff_hit_positions(spark, sf):
    hits = spark.createDataFrame(X.GFF_ROWS, "contig string, start int, stop int, strand string, attributes string, contig_len int")
    return motifs.gff_positions(hits, spark.createDataFrame([("m6A_GATC_1", 1, 1)], "name string, meth_id int, pos int"))


# ---------------------------------------------------------------- scan and training


def _scan_sql(compiled):
    return f"""WITH {X.READS_SQL}, pos AS ({X.places_sql('reads', 'doc_id')}), marked AS ({X.marks_sql('pos', 'doc_id', compiled)})
    SELECT doc_id, CAST(p AS BIGINT) AS pos, CAST(meth_id AS INTEGER) AS meth_id FROM marked WHERE meth_id <> 0"""


@query(_scan_sql(FORWARD))
def motif_scan_fwd(spark, sf):
    return train.marks(X.reads(spark, sf), FORWARD, ["doc_id"])


@query(_scan_sql(COMPILED))
def motif_scan_revcomp(spark, sf):
    return train.marks(X.reads(spark, sf), COMPILED, ["doc_id"])


_CONFLICT = motifs.compile_motifs("m6A,GATC,1;m4C,NATC,1;odd,CATC,1", both_strands=False)


@query(_scan_sql(_CONFLICT))
def motif_precedence(spark, sf):
    return train.marks(X.reads(spark, sf), _CONFLICT, ["doc_id"])


@query(f"WITH {_DICT} SELECT * FROM dict")
def dict_train(spark, sf):
    return _table(spark, sf)


@query(f"WITH {_W} SELECT strain, kmer, meth_id, {X.MOMENTS_SQL} FROM win GROUP BY strain, kmer, meth_id")
def dict_train_by_strain(spark, sf):
    return train.moments(X.reads(spark, sf), COMPILED, ["strain"])


@query(f"WITH {_DICT} SELECT * FROM dict")
def dict_merge(spark, sf):
    shards = [train.moments(X.reads(spark, sf).where(f"doc_id % 3 = {k}"), COMPILED) for k in range(3)]
    return train.merge(shards[0].unionByName(shards[1]).unionByName(shards[2]))


def _params_sql(prefix: str = "") -> str:
    m = lambda s: f"CASE WHEN coalesce({prefix}n, 0) < 1 THEN 1.0 ELSE {prefix}{s} / {prefix}n END"
    d = lambda s: f"CASE WHEN coalesce({prefix}n, 0) < 1 THEN 0.1 ELSE sqrt(greatest(0.0, {prefix}{s}2 / {prefix}n - ({prefix}{s} / {prefix}n) * ({prefix}{s} / {prefix}n))) END"
    return f"CAST({m('sum_ipd')} AS DOUBLE) AS mu_ipd, CAST({d('sum_ipd')} AS DOUBLE) AS sigma_ipd, CAST({m('sum_pw')} AS DOUBLE) AS mu_pw, CAST({d('sum_pw')} AS DOUBLE) AS sigma_pw"


@query(f"WITH {_DICT} SELECT kmer, meth_id, {_params_sql()} FROM dict")
def signal_stats_mu_sigma(spark, sf):
    n = F.col("n")
    return _table(spark, sf).select(
        "kmer", "meth_id", signal.mu(n, F.col("sum_ipd")).alias("mu_ipd"), signal.sigma(n, F.col("sum_ipd"), F.col("sum_ipd2")).alias("sigma_ipd"),
        signal.mu(n, F.col("sum_pw")).alias("mu_pw"), signal.sigma(n, F.col("sum_pw"), F.col("sum_pw2")).alias("sigma_pw"),
    )


_COV = "CAST(count(*) AS BIGINT) AS entries, CAST(count(*) * 100.0 / 4194304 AS DOUBLE) AS pct, avg(n) AS mean_n, CAST(median(n) AS DOUBLE) AS median_n, min(n) AS min_n, max(n) AS max_n, CAST(sum(n) AS BIGINT) AS total_n"


@query(f"WITH {_DICT} SELECT meth_id, {_COV} FROM dict GROUP BY meth_id")
def coverage_report(spark, sf):
    return train.coverage(_table(spark, sf)).withColumn("pct", F.col("pct").cast("double"))


@query(f"WITH {_DICT} SELECT {_COV} FROM dict WHERE meth_id <> 0")
def coverage_combined(spark, sf):
    return train.coverage_combined(_table(spark, sf)).withColumn("pct", F.col("pct").cast("double"))


def _strain_sql() -> str:
    def pair(c, name):
        mean = f"(CAST(sum({c}) AS DOUBLE) / count({c}))"
        return f"CASE WHEN count({c}) = 0 THEN 0.0 ELSE round({mean}, 4) END AS mean_{name}, CASE WHEN count({c}) = 0 THEN 0.0 ELSE round(sqrt(greatest(0.0, CAST(sum({c} * {c}) AS DOUBLE) / count({c}) - {mean} * {mean})), 4) END AS std_{name}"

    return f"WITH {X.READS_SQL}, i AS (SELECT strain, unnest(list_concat(fi, ri)) AS x FROM reads), p AS (SELECT strain, unnest(list_concat(fp, rp)) AS x FROM reads) SELECT s.strain, mean_ipd, std_ipd, mean_pw, std_pw FROM (SELECT DISTINCT strain FROM reads) s LEFT JOIN (SELECT strain, {pair('x', 'ipd')} FROM i GROUP BY strain) a USING (strain) LEFT JOIN (SELECT strain, {pair('x', 'pw')} FROM p GROUP BY strain) b USING (strain)"


@query(_strain_sql())
def strain_stats(spark, sf):
    return train.strain_stats(X.reads(spark, sf))


@query(f"SELECT string_split('lib.' || strain, '.')[-1] AS label, mean_ipd, std_ipd, mean_pw, std_pw FROM ({_strain_sql()})")
def strain_bars(spark, sf):
    return train.strain_bars(train.strain_stats(X.reads(spark, sf).withColumn("strain", F.concat(F.lit("lib."), "strain"))))


@query(f"WITH {_DICT} SELECT round(avg(sum_ipd / n), 6) AS mean_ipd, round(avg(sum_pw / n), 6) AS mean_pw FROM dict WHERE meth_id = 0")
def global_unmeth_mean(spark, sf):
    return _table(spark, sf).where("meth_id = 0").agg(F.round(F.avg(F.col("sum_ipd") / F.col("n")), 6).alias("mean_ipd"), F.round(F.avg(F.col("sum_pw") / F.col("n")), 6).alias("mean_pw"))


_EXTRACT, _MERGE = 10_000, 50_000
_ORDER_SQL = "md5(CAST(doc_id AS VARCHAR) || ':' || CAST({} AS VARCHAR))"


def _order():
    return F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("pos").cast("string")))


def _capped(limit, src, by=""):
    return f"SELECT doc_id, pos, kmer, meth_id, ipd, pw{by} FROM (SELECT *, row_number() OVER (PARTITION BY kmer, meth_id{by} ORDER BY {_ORDER_SQL.format('pos')}) AS rn FROM {src}) WHERE rn <= {limit}"


_S = "s AS (SELECT doc_id, CAST(i AS INTEGER) AS pos, kmer, meth_id, CAST(ipd AS FLOAT) AS ipd, CAST(pw AS FLOAT) AS pw, strain FROM win)"


@query(f"WITH {_W}, {_S} {_capped(_EXTRACT, 's')}")
def sample_cap_extract(spark, sf):
    return train.capped_samples(X.packed(spark, sf), COMPILED, "doc_id", None, _EXTRACT, _EXTRACT)


@query(f"WITH {_W}, {_S}, parts AS ({_capped(_EXTRACT, 's', ', strain')}) {_capped(_MERGE, 'parts')}")
def sample_cap_merge(spark, sf):
    return train.capped_samples(X.packed(spark, sf), COMPILED, "doc_id", "strain", _EXTRACT, _MERGE)


@query(f"WITH {_W}, {_S}, c AS ({_capped(_EXTRACT, 's')}) SELECT CAST(count(*) AS BIGINT) AS contexts, CAST(sum(n) AS BIGINT) AS samples FROM (SELECT kmer, meth_id, count(*) AS n FROM c GROUP BY kmer, meth_id)")
def sample_totals(spark, sf):
    g = sample_cap_extract(spark, sf).groupBy("kmer", "meth_id").agg(F.count("*").alias("n"))
    return g.agg(F.count("*").alias("contexts"), F.sum("n").alias("samples"))


# ---------------------------------------------------------------- injection


def _joined(spark, sf):
    r = X.reads(spark, sf).select("doc_id", "read_name", "species", "seq")
    c = X.contigs(X.reads(spark, sf))
    return inject.mapped(r, X.alignments(r, c), c), c


def _placed(spark, sf):
    r = X.reads(spark, sf).select("doc_id", "read_name", "species", "seq")
    c = X.contigs(X.reads(spark, sf))
    return inject.placed(r, X.alignments(r, c), c), c


_J = f"{X.READS_SQL}, {X.REF_SQL}"


@query(f"WITH {_J} SELECT species, read_name, ref_name, ref_start, ref_strand, ref_src_size FROM mapped")
def reads_maf_join(spark, sf):
    return _placed(spark, sf)[0].select("species", "read_name", "ref_name", "ref_start", "ref_strand", "ref_src_size")


@query(f"WITH {_J} SELECT species, CAST(count(*) AS BIGINT) AS total, CAST(count(contig_seq) AS BIGINT) AS n_mapped, CAST(count(*) - count(contig_seq) AS BIGINT) AS n_unmapped FROM mapped GROUP BY species")
def mapped_unmapped_counts(spark, sf):
    return _placed(spark, sf)[0].groupBy("species").agg(F.count("*").alias("total"), F.count("clen").alias("n_mapped"), (F.count("*") - F.count("clen")).alias("n_unmapped"))


_CTX = "substring(repeat(contig_seq, 3), CAST(((ref_start - 5) % length(contig_seq) + length(contig_seq)) % length(contig_seq) AS INTEGER) + 1, length(seq) + 10)"


@query(f"WITH {_J} SELECT species, read_name, {_CTX} AS ctx FROM mapped WHERE contig_seq IS NOT NULL AND length(seq) + 10 <= length(contig_seq)")
def context_circular(spark, sf):
    j = _joined(spark, sf)[0].where("contig_seq is not null and length(seq) + 10 <= length(contig_seq)")
    return j.select("species", "read_name", inject.context(F.col("contig_seq"), F.col("ref_start"), F.length("seq"), True).alias("ctx"))


_LINEAR = "substring(repeat('N', 5) || contig_seq || repeat('N', 10 + length(seq)), CAST(ref_start + 1 AS INTEGER), length(seq) + 10)"


@query(f"WITH {_J} SELECT species, read_name, {_LINEAR} AS ctx FROM mapped WHERE contig_seq IS NOT NULL")
def context_linear(spark, sf):
    j = _joined(spark, sf)[0].where("contig_seq is not null")
    return j.select("species", "read_name", inject.context(F.col("contig_seq"), F.col("ref_start"), F.length("seq"), False).alias("ctx"))


@query(
    f"""WITH {_J}, l AS (SELECT species, read_name, {_LINEAR} AS ctx FROM mapped WHERE contig_seq IS NOT NULL), b AS ({X.places_sql('l', 'species, read_name', 'ctx')})
    SELECT species, read_name, CAST(count(*) AS BIGINT) AS bases, CAST(count(*) FILTER (WHERE contains(left(w, 11), 'N')) AS BIGINT) AS defaults FROM b WHERE p + 11 <= n GROUP BY species, read_name"""
)
def n_window_default(spark, sf):
    j, c = _placed(spark, sf)
    b = inject.placed_bases(j, inject.tiles(c, _contig_marks(c), circular=False), circular=False)
    return b.groupBy("species", "read_name").agg(F.count("*").alias("bases"), F.count(F.when(F.col("is_n"), 1)).alias("defaults"))


def _contig_marks(c):
    return train.marks(c, COMPILED, ["species", "contig"])


_CMARK = f"cpos AS ({X.places_sql('contigs', 'species, contig')}), cmark AS ({X.marks_sql('cpos', 'species, contig', COMPILED)})"
_MBASE = f"""mb0 AS (SELECT species, read_name, {_CTX.replace("repeat(contig_seq, 3)", "repeat(contig_seq, 3 + CAST(length(seq) // length(contig_seq) AS INTEGER))")} AS ctx, ref_name, ref_start, length(contig_seq) AS clen FROM mapped WHERE contig_seq IS NOT NULL),
mb1 AS ({X.places_sql('mb0', 'species, read_name, ref_name, ref_start, clen', 'ctx')}),
mb AS (SELECT b.species, b.read_name, CAST(b.p AS INTEGER) AS pos, {X.encode_sql("b.w")} AS kmer, CAST(coalesce(c.meth_id, 0) AS INTEGER) AS meth_id, false AS is_n
  FROM mb1 b LEFT JOIN cmark c ON c.species = b.species AND c.contig = b.ref_name AND c.p = (b.ref_start + b.p) % b.clen WHERE b.p + 11 <= b.n)"""
_FULL = f"{_DICT}, {X.REF_SQL}, {_CMARK}, {_MBASE}"


@query(f"WITH {_FULL} SELECT mb.species, read_name, pos, mb.kmer, mb.meth_id, is_n, {_params_sql('d.')} FROM mb LEFT JOIN dict d ON d.kmer = mb.kmer AND d.meth_id = mb.meth_id")
def inject_params_mapped(spark, sf):
    r = X.sizes(spark, sf)
    sizes = X.contig_sizes(r)
    j = inject.placed(r, X.alignments(r, sizes), sizes)
    return inject.placed_bases(j, inject.tiles(X.contigs(X.reads(spark, sf)), COMPILED), table=inject.Known(_table(spark, sf)))


_UBASE = f"""um AS (SELECT doc_id, species, read_name, seq FROM mapped WHERE contig_seq IS NULL), upos AS ({X.places_sql('um', 'doc_id, species, read_name')}), umark AS ({X.marks_sql('upos', 'doc_id', COMPILED)}),
ub AS (SELECT x.species, x.read_name, CAST(x.p AS INTEGER) AS pos, CASE WHEN x.p >= 10 THEN {X.encode_sql("e.w")} END AS kmer, CAST(CASE WHEN x.p < 10 THEN 0 ELSE coalesce(m.meth_id, 0) END AS INTEGER) AS meth_id, x.p < 10 AS is_n
  FROM upos x LEFT JOIN upos e ON e.doc_id = x.doc_id AND e.p = x.p - 10 LEFT JOIN umark m ON m.doc_id = x.doc_id AND m.p = x.p - 5)"""


@query(f"WITH {_DICT}, {X.REF_SQL}, {_UBASE} SELECT ub.species, read_name, pos, ub.kmer, ub.meth_id, is_n, {_params_sql('d.')} FROM ub LEFT JOIN dict d ON d.kmer = ub.kmer AND d.meth_id = ub.meth_id AND NOT is_n")
def inject_params_unmapped(spark, sf):
    j, _ = _placed(spark, sf)
    return inject.unmapped_bases(j, train.marks(j.where("clen is null"), COMPILED, ["species", "read_name"]), inject.Known(_table(spark, sf)))


def _uniform_sql(key: str, part: int) -> str:
    return f"((CAST(('0x' || substring(md5({key}), {1 + 8 * part}, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


_KEY = "concat_ws('|', '0', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR))"


@query(f"SELECT l_orderkey, l_linenumber, CAST(least(255, round_even(greatest(0.0, 36.1::DOUBLE + 29.4::DOUBLE * (sqrt(-2.0::DOUBLE * ln({_uniform_sql(_KEY, 0)})) * cos(6.283185307179586::DOUBLE * {_uniform_sql(_KEY, 1)}))), 0)) AS INTEGER) AS ipd FROM lineitem")
def gaussian_sample(spark, sf):
    key = F.concat_ws("|", F.lit("0"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", signal.sample(F.lit(36.1), F.lit(29.4), key).alias("ipd"))


@query("SELECT event_id, round(ln(1 + abs(CAST(value AS DOUBLE))), 9) AS logged, round(least(255.0, greatest(0.0, exp(ln(1 + abs(CAST(value AS DOUBLE)))) - 1)), 6) AS back FROM events")
def log1p_roundtrip(spark, sf):
    x = signal.to_log(F.abs(F.col("value").cast("double")))
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.round(x, 9).alias("logged"), F.round(signal.from_log(x), 6).alias("back"))


@query("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 1 ELSE CAST(trunc(least(255.0, greatest(0.0, CAST(value AS DOUBLE)))) AS INTEGER) END AS q FROM events")
def quantise_uint8(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", signal.quantise(F.col("value").cast("double"), F.col("event_id") % 10 == 0).alias("q"))


@query(f"WITH {X.READS_SQL} SELECT read_name, species, CAST(row_number() OVER (ORDER BY doc_id, species) AS BIGINT) AS place FROM reads")
def pool_species_sorted(spark, sf):
    """Pooled reads in natural name order: r2 before r10."""
    pooled = X.reads(spark, sf).select("read_name", "species")
    placed = numbered(pooled, "place", inject.natural_key("read_name"), F.col("species"))
    return placed.withColumn("place", F.col("place") + 1)


@query(f"WITH {X.READS_SQL} SELECT strain, CAST(count(*) AS BIGINT) AS n_reads FROM reads WHERE strain NOT IN ({', '.join(repr(x) for x in X.EXCLUDED)}) GROUP BY strain")
def strain_exclusion(spark, sf):
    bad = spark.createDataFrame([(x,) for x in X.EXCLUDED], "strain string")
    return X.reads(spark, sf).select("strain").join(bad, "strain", "left_anti").groupBy("strain").agg(F.count("*").alias("n_reads"))


@query(f"WITH {X.READS_SQL}, m AS {X._values(X.SPECIES_MOTIFS, 'species, motifs')} SELECT r.species, m.motifs, CAST(count(*) AS BIGINT) AS n_reads FROM reads r LEFT JOIN m USING (species) GROUP BY r.species, m.motifs")
def species_motif_join(spark, sf):
    m = spark.createDataFrame(X.SPECIES_MOTIFS, "species string, motifs string")
    return X.reads(spark, sf).select("species").join(m, "species", "left").groupBy("species", "motifs").agg(F.count("*").alias("n_reads"))


@query(f"SELECT path, motifs FROM {X._values(X.PAIRS, 'path, motifs')} WHERE motifs <> '' AND NOT contains(motifs, '/') AND NOT ends_with(motifs, '.csv') AND NOT ends_with(motifs, '.txt')")
def prepare_pairs(spark, sf):
    from pulsegrid.operators.prepare import prepared

    lines = [x for p, m in X.PAIRS for x in (p, m or "/gone/none.txt")]
    return spark.createDataFrame(prepared(spark, lines), "path string, motifs string")


_WF_MARK = f"{_DICT}, all_pos AS ({X.places_sql('reads', 'doc_id')}), all_mark AS ({X.marks_sql('all_pos', 'doc_id', FORWARD)}), plain AS (SELECT avg(sum_ipd / n) AS mi, avg(sum_pw / n) AS mp FROM dict WHERE meth_id = 0)"


def _edge_sql(name: str, mean: str) -> str:
    key = f"concat_ws('|', '0', CAST(b.doc_id AS VARCHAR), CAST(b.p AS VARCHAR), '{name}')"
    mu = f"CASE WHEN edge THEN {mean} WHEN d.n IS NULL THEN 1.0 ELSE d.sum_{name} / d.n END"
    sd = f"CASE WHEN edge THEN 0.2 WHEN d.n IS NULL THEN 0.1 ELSE sqrt(greatest(0.0, d.sum_{name}2 / d.n - (d.sum_{name} / d.n) * (d.sum_{name} / d.n))) END"
    normal = f"sqrt(-2.0::DOUBLE * ln({_uniform_sql(key, 0)})) * cos(6.283185307179586::DOUBLE * {_uniform_sql(key, 1)})"
    return f"floor(greatest(0.0::DOUBLE, CAST({mu} AS DOUBLE) + CAST({sd} AS DOUBLE) * ({normal})) * 255)"


@query(
    f"""WITH {_WF_MARK}, b AS (SELECT x.doc_id, x.p, x.p < 5 OR x.p > x.n - 6 AS edge, c.w AS around, coalesce(m.meth_id, 0) AS meth_id
      FROM all_pos x LEFT JOIN all_pos c ON c.doc_id = x.doc_id AND c.p = x.p - 5 LEFT JOIN all_mark m ON m.doc_id = x.doc_id AND m.p = x.p),
    k AS (SELECT doc_id, p, edge, CASE WHEN NOT edge THEN {X.encode_sql('around')} END AS kmer, meth_id FROM b)
    SELECT doc_id, count(*) AS bases, count(*) FILTER (WHERE edge) AS edge_bases, CAST(sum({_edge_sql('ipd', 'mi')}) AS BIGINT) AS sum_ipd, CAST(sum({_edge_sql('pw', 'mp')}) AS BIGINT) AS sum_pw
    FROM k b CROSS JOIN plain LEFT JOIN dict d ON d.kmer = b.kmer AND d.meth_id = b.meth_id GROUP BY doc_id"""
)
def edge_noise_frame(spark, sf):
    """Signals of every base with noise at the edges of reads; forward motifs only. Summed per read."""
    per_read = inject.edge_noise_sums(X.packed(spark, sf), FORWARD, _table(spark, sf), ["doc_id"])
    return per_read.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("bases", "edge_bases", "sum_ipd", "sum_pw")])


@query(f"""WITH {X.READS_SQL} SELECT read_name, seq, {', '.join(f"coalesce('[' || array_to_string({t}, ', ') || ']', 'None') AS {t}" for t in ('fi', 'ri', 'fp', 'rp'))} FROM reads WHERE length(seq) > 0""")
def bam_dump(spark, sf):
    """Every read with a sequence and its four tags, as the reference prints them."""
    text = lambda c: F.coalesce(F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]")), F.lit("None"))
    return X.reads(spark, sf).where("length(seq) > 0").select("read_name", "seq", *[text(F.col(t)).alias(t) for t in ("fi", "ri", "fp", "rp")])


@query(f"WITH {X.READS_SQL}, v AS (SELECT doc_id, least(length(seq), len(fi), len(fp)) AS n FROM reads WHERE length(seq) >= 11) SELECT doc_id, CAST(n - 10 AS BIGINT) AS windows FROM v WHERE n >= 11 ORDER BY doc_id LIMIT 50")
def bounded_scan(spark, sf):
    """The first 50 valid reads: a limit that is the feature."""
    r = train.usable(X.reads(spark, sf)).withColumn("n", F.least(F.length("seq"), F.size("fi"), F.size("fp"))).where("n >= 11")
    return r.orderBy("doc_id").limit(50).select("doc_id", (F.col("n") - 10).cast("long").alias("windows"))


@query(f"WITH {X.READS_SQL} SELECT read_name || chr(9) || '4' || chr(9) || '*' || chr(9) || '0' || chr(9) || '255' || chr(9) || '*' || chr(9) || '*' || chr(9) || '0' || chr(9) || '0' || chr(9) || seq || chr(9) || '*' || chr(9) || 'fi:B:C,' || array_to_string(fi, ',') || chr(9) || 'fp:B:C,' || array_to_string(fp, ',') AS line FROM reads WHERE length(seq) > 10")
def sam_lines(spark, sf):
    tag = lambda t, c: F.concat(F.lit(f"{t}:B:C,"), F.array_join(c, ","))
    r = X.reads(spark, sf).where("length(seq) > 10")
    return r.select(F.concat_ws("\t", "read_name", *[F.lit(x) for x in ("4", "*", "0", "255", "*", "*", "0", "0")], "seq", F.lit("*"), tag("fi", F.col("fi")), tag("fp", F.col("fp"))).alias("line"))


def _folder(spark, name: str) -> str:
    """A new folder for files in the shared one, which goes with it at the end."""
    at = scratch_path(spark, name)
    return at.removeprefix("file://")


@query(f"WITH {X.READS_SQL} SELECT read_name, CAST(4 AS INTEGER) AS flag, CASE WHEN length(seq) > 0 THEN seq END AS seq, array_to_string(fi, ',') AS fi, array_to_string(fp, ',') AS fp, strain AS rg FROM reads")
def bam_round_trip(spark, sf):
    """All reads through BAM files and back."""
    files.register(spark)
    at = _folder(spark, "bam")
    X.reads(spark, sf).select("read_name", "seq", "fi", "fp", F.col("strain").alias("rg")).write.format("bam").mode("overwrite").save(at)
    return spark.read.format("bam").load(at).select("read_name", "flag", "seq", F.array_join("fi", ",").alias("fi"), F.array_join("fp", ",").alias("fp"), "rg")


@query(f"WITH {X.READS_SQL} SELECT read_name, seq, repeat('I', length(seq)) AS qual FROM reads")
def fastq_round_trip(spark, sf):
    """All reads through plain FASTQ files and back; large ones are read in pieces."""
    files.register(spark)
    at = _folder(spark, "fastq")
    r = X.reads(spark, sf)
    record = F.concat(F.lit("@"), "read_name", F.lit(" x\n"), "seq", F.lit("\n+\n"), F.repeat(F.lit("I"), F.length("seq")))
    r.select(record.alias("value")).write.text(at)
    return spark.read.format("fastq").load(f"{at}/*.txt").select("read_name", "seq", "qual")


@query(f"WITH {X.READS_SQL}, {X.REF_SQL} SELECT contig, seq FROM contigs")
def fasta_round_trip(spark, sf):
    """All contigs through FASTA files of 60-letter lines and back."""
    files.register(spark)
    at = _folder(spark, "fasta")
    c = X.contigs(X.reads(spark, sf))
    c.select(F.concat(F.lit(">"), "contig", F.lit(" x\n"), F.regexp_replace(F.lower("seq"), "(.{60})", "$1\n")).alias("value")).write.text(at)
    return spark.read.format("fasta").load(f"{at}/*.txt").select("contig", "seq")


@query(f"WITH {X.READS_SQL}, {X.REF_SQL} SELECT read_name, ref_name, ref_start, ref_strand, ref_src_size FROM aln0")
def maf_round_trip(spark, sf):
    """All alignments through MAF files and back."""
    files.register(spark)
    at = _folder(spark, "maf")
    r = X.reads(spark, sf)
    a = inject.last_alignment(X.alignments(r, X.contigs(r)))
    ref = F.concat_ws(" ", F.lit("s"), "ref_name", F.col("ref_start").cast("string"), F.lit("1"), "ref_strand", F.col("ref_src_size").cast("string"), F.lit("A"))
    a.select(F.concat(F.lit("a\n"), ref, F.lit("\ns "), "read_name", F.lit(" 0 1 + 1 A\n")).alias("value")).write.text(at)
    return spark.read.format("maf").load(f"{at}/*.txt").select("read_name", "ref_name", "ref_start", "ref_strand", "ref_src_size")


_GFF_LINES = ["##gff", "", *["\t".join([c, "tool", "match", str(a), str(b), "0", s, ".", t]) for c, a, b, s, t, _ in X.GFF_ROWS], "c1\ttoo\tfew"]


@query(f"SELECT contig, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, strand, attributes FROM {X._values([r[:5] for r in X.GFF_ROWS], 'contig, start, stop, strand, attributes')}")
def gff_scan(spark, sf):
    """Hits of a fuzzy search through a file and back: comments, blank and short lines go."""
    at = _folder(spark, "gff")
    spark.createDataFrame([(x,) for x in _GFF_LINES], "value string").write.text(at)
    return motifs.read_gff(spark, at).select("contig", "start", "stop", "strand", "attributes")


@query(f"SELECT fastq, maf, ref, dict, motifs FROM {X._values([x[:5] for x in X.JOBS if len(x) >= 5 and x[0]], 'fastq, maf, ref, dict, motifs')}")
def inject_config(spark, sf):
    """A pipe-delimited list of injection jobs."""
    from pulsegrid.operators.prepare import inject_jobs

    at = _folder(spark, "jobs")
    spark.createDataFrame([("|".join(x),) for x in X.JOBS], "value string").coalesce(1).write.text(at)
    return spark.createDataFrame(inject_jobs(spark, at), "fastq string, maf string, ref string, dict string, motifs string")


@query(f"""WITH n AS (SELECT * FROM {X._values([(m,) for m in X.IUPAC_ROWS], 'motif')}), c AS (SELECT motif, i, substring(motif, i, 1) AS c FROM (SELECT motif, unnest(range(1, length(motif) + 1)) AS i FROM n))
    SELECT n.motif, coalesce(string_agg(CASE c {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in (('N', '.'), ('R', '[AG]'), ('Y', '[CT]'), ('S', '[CG]'), ('W', '[AT]'), ('K', '[GT]'), ('M', '[AC]'), ('B', '[CGT]'), ('D', '[AGT]'), ('H', '[ACT]'), ('V', '[ACG]')))} ELSE c END, '' ORDER BY i), '') AS re FROM n LEFT JOIN c USING (motif) GROUP BY n.motif""")
def iupac_regex(spark, sf):
    """The SQL function of that name."""
    kmer.register(spark)
    return spark.createDataFrame([(m,) for m in X.IUPAC_ROWS], "motif string").selectExpr("motif", "iupac_regex(motif) AS re")


@query()
def gan_generate(spark, sf):
    """Signals of all reads from a generator with seeded weights (a trained one is loaded from its checkpoint)."""
    from pulsegrid.gan import infer, model

    return infer.generate_samples(X.packed(spark, sf), COMPILED, ["doc_id"], model.new_generator(seed=1))


__all__ = ["QUERIES", "SQL"]
