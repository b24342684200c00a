"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and
one bit per failed rule.  Policies are versioned masks over those bits, so a new
policy or an ablation reads the small ledger and never the texts again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import unused
from .textkernel import EXACT, IS_WS, Words, slices, span_hashes, whole_windows, window_hashes

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper_words"]

#: (name, failure condition over the measurements); a rule's bit is its place in this list, and places never change.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "2 * n_dup_lines > n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("upper_case", "10 * n_upper_words > 3 * n_words"),
    ("no_words", "n_words < 1"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}

#: Versioned policies: a document is kept if none of the policy's bits is set.
POLICIES: dict[str, int] = {
    "base-1": BIT["few_words"] | BIT["repeated_windows"],
    "web-1": sum(BIT[x] for x in ("few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words", "upper_case")),
    # short texts stay: of labelled good ones about a twentieth has few words, and no other rule rejects them
    "web-2": sum(BIT[x] for x in ("repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words", "upper_case", "no_words")),
}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER, _SMALL = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _SMALL[97:123] = True
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False  # continuation bytes start no code point


def _sums(flags: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[hi] - total[lo]


def _first_in_group(rows: np.ndarray, vals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by (row, value), and the marks of each group's first in it."""
    order = np.lexsort((vals, rows))
    r, v = rows[order], vals[order]
    new = np.ones(len(order), bool)
    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    return order, new


def measure(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The measurements of each row of a slice."""
    n = len(off) - 1
    words = Words(buf, off)
    out = {"n_words": words.n.astype(np.int64)}
    out["word_chars"] = _sums(_LEAD[buf] & ~IS_WS[buf], off[:-1], off[1:])
    out["n_symbols"] = _sums(_SYMBOL[buf], off[:-1], off[1:])
    upper = (_sums(_UPPER[buf], words.starts, words.ends) >= 2) & (_sums(_SMALL[buf], words.starts, words.ends) == 0)
    out["n_upper_words"] = _sums(upper, words.first[:-1], words.first[1:])

    # lines: cut at each \n and at row ends; only those with a word count
    cut = np.flatnonzero(buf == 10)
    lo = np.unique(np.concatenate((off[:-1], cut + 1)))
    row = np.searchsorted(off[1:], lo, "right")
    keep = row < n  # a start at the very end of the bytes belongs to no text that has words
    lo, row = lo[keep], row[keep]
    at = np.searchsorted(cut, lo)
    hi = np.minimum(np.append(cut, len(buf))[at], off[1:][row]) if n else lo
    hi = np.maximum(hi, lo)
    filled = np.searchsorted(words.starts, hi) > np.searchsorted(words.starts, lo)
    lo, hi, row = lo[filled], hi[filled], row[filled]
    out["n_lines"] = np.bincount(row, minlength=n).astype(np.int64)
    order, new = _first_in_group(row, span_hashes(buf, lo, hi, EXACT))
    out["n_dup_lines"] = np.bincount(row[order][~new], minlength=n).astype(np.int64)

    # three-word windows found twice or more: every word of each of them counts once
    at = whole_windows(words, 3)
    rows = words.row()
    marked = np.zeros(len(rows) + 2, bool)
    if len(at):
        order, new = _first_in_group(rows[at], window_hashes(words.hashes(EXACT), 3)[at])
        again = ~new
        again[:-1] |= ~new[1:]  # the first of a group of two or more
        hit = at[order[again]]
        marked[hit] = marked[hit + 1] = marked[hit + 2] = True
    out["n_repeat_words"] = np.bincount(rows[marked[: len(rows)]], minlength=n).astype(np.int64)
    return out


def measurements(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default, without the text) and the measurements, in one pass over the texts."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != text and c not in MEASURES]
    whole = unused("text", keep)
    src = docs.select(*keep, F.col(text).alias(whole))
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != whole] + [f"{m} bigint" for m in MEASURES])

    def run(batches):
        for part, buf, off in slices(batches, whole):
            got = measure(buf, off)
            yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(got[m], pa.int64()) for m in MEASURES], names=keep + MEASURES)

    return src.mapInArrow(run, fields)


def failure_bits() -> Column:
    """The ledger's bitmask from the measurements."""
    bits = F.lit(0).cast("long")
    for k, (_, fails) in enumerate(RULES):
        bits = bits + F.when(F.expr(fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
    return bits


def ledger(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per document: its kept columns, every measurement, and ``failed_bits``.

    A null or empty text has zero for all measurements and fails ``few_words``.
    Repeated rows each get a row; columns named like a measurement are replaced by it.
    """
    return measurements(docs, text, keep).withColumn("failed_bits", failure_bits())


def passes(policy: str, bits: str = "failed_bits") -> Column:
    """Whether a ledger row passes the named policy."""
    return F.col(bits).bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablations(entries: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, fail it alone, and are kept without it.

    Documents are first counted by bit pattern (at most 2 ** rules), so what is
    exploded per rule does not grow with the input.
    """
    mask = POLICIES[policy]
    patterns = entries.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("long").alias("bit")) for name, _ in RULES if BIT[name] & mask])
    each = patterns.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    failed = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule", "bit").agg(
        F.sum(F.when(failed, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )
