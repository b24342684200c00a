"""k-mer and sequence functions as Column expressions, and the numpy kernels behind the Arrow operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

K = 11
CENTER = 5
#: Numbers of the methylation types.
METH_IDS = {"none": 0, "m6A": 1, "m4C": 2, "m5C": 3}
#: IUPAC letters and the bases they stand for.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
#: Letters and their complements; S, W and N are their own.
COMPLEMENT = ("ACGTYRKMBVDH", "TGCARYMKVBHD")


def encode(seq: Column) -> Column:
    """Base-4 number of an ACGT string, first base most significant; null where another letter occurs."""
    return F.when(seq.rlike("^[ACGT]+$"), F.conv(F.translate(seq, "ACGT", "0123"), 4, 10).cast("int"))


def decode(kmer: Column, k: int = K) -> Column:
    return F.translate(F.lpad(F.conv(kmer.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, *COMPLEMENT))


def iupac_to_regex(motif: str) -> str:
    return "".join("." if c == "N" else c if len(IUPAC.get(c, c)) == 1 else f"[{IUPAC[c]}]" for c in motif)


def revcomp(motif: str) -> str:
    return motif.translate(str.maketrans(*COMPLEMENT))[::-1]


def sliding(seq: Column, k: int = K) -> Column:
    """Array of the k-mer numbers of every window; letters other than ACGT count as A. For short texts: ``operators.train.kmers`` counts those of whole reads."""
    clean = F.array(F.translate(F.regexp_replace(seq, "[^ACGT]", "A"), "ACGT", "0123"))  # bound once, not per window
    n = F.length(seq)
    windows = F.transform(clean, lambda c: F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.conv(F.substring(c, i, F.lit(k)), 4, 10).cast("int")))
    return F.when(n >= k, windows[0]).otherwise(F.array().cast("array<int>"))


def register(spark: SparkSession) -> None:
    """SQL functions kmer_encode, kmer_decode, revcomp and iupac_regex, as SQL expressions that Catalyst inlines."""
    letters = " ".join(f"WHEN '{c}' THEN '{iupac_to_regex(c)}'" for c in IUPAC)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION iupac_regex(s STRING) RETURNS STRING RETURN array_join(transform(split(s, ''), c -> CASE c {letters} ELSE c END), '')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION kmer_encode(s STRING) RETURNS INT RETURN CASE WHEN s RLIKE '^[ACGT]+$' THEN CAST(conv(translate(s, 'ACGT', '0123'), 4, 10) AS INT) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION kmer_decode(k INT) RETURNS STRING RETURN translate(lpad(conv(CAST(k AS STRING), 10, 4), 11, '0'), '0123', 'ACGT')")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION revcomp(s STRING) RETURNS STRING RETURN reverse(translate(s, '{COMPLEMENT[0]}', '{COMPLEMENT[1]}'))")


# ---------------------------------------------------------------- kernels

FIRST = 4  # letters of a motif that are compared at every place

_CODE = np.zeros(256, np.int32)
_BIT = np.full(256, 16, np.uint8)
for _i, _c in enumerate(b"ACGT"):
    _CODE[_c], _BIT[_c] = _i, 1 << _i


def kmer_codes(buf: np.ndarray, k: int = K) -> np.ndarray:
    """k-mer number of the window that starts at each byte (shorter by k - 1)."""
    n = max(0, len(buf) - k + 1)
    out, have, power, size = np.zeros(n, np.int32), 0, _CODE[buf], 1
    while have < k:  # windows of 1, 2, 4, ... letters, joined as the bits of k say
        if k & size:
            out = out << 2 * size | power[have : have + n]
            have += size
        if have < k:
            power = power[: len(power) - size] << 2 * size | power[size:]
            size *= 2
    return out


def scan(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, motifs: list) -> np.ndarray:
    """Methylation id of each byte of rows [starts, ends); later motifs overwrite earlier ones, targets outside a row are dropped. Rows stand in order and do not overlap."""
    meth = np.zeros(len(buf), np.int8)
    if not len(buf) or not len(starts):
        return meth
    bits = _BIT[buf]
    is_letter: dict[str, np.ndarray] = {}
    for m in motifs:
        n = len(buf) - len(m.motif) + 1
        if n <= 0:
            continue
        letters = [(j, c) for j, c in enumerate(m.motif) if c != "N"]
        hit = np.ones(n, bool)
        for j, c in letters[:FIRST]:
            if c not in is_letter:
                is_letter[c] = (bits & sum(1 << "ACGT".index(x) for x in IUPAC[c])) != 0 if c in IUPAC else buf == ord(c)
            hit &= is_letter[c][j : j + n]
        p = np.flatnonzero(hit)
        for j, c in letters[FIRST:]:  # few places are left
            p = p[(bits[p + j] & sum(1 << "ACGT".index(x) for x in IUPAC[c])) != 0 if c in IUPAC else buf[p + j] == ord(c)]
        row = np.searchsorted(starts, p, "right") - 1
        # empty rows share their start with the next: the last of them is the one that has letters
        low, high = starts[row], np.where((row >= 0) & (p < ends[row]), ends[row], 0)
        fits = p + len(m.motif) <= high
        t, low, high = (p + m.offset)[fits], low[fits], high[fits]
        meth[t[(t < high) & (t >= low)]] = m.meth_id
    return meth
