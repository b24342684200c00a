"""Learning the kinetic table: methylation marks, windows and moments per (11-mer, methylation)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from pulsegrid.functions.digest import decimal_md5
from pulsegrid.functions.kmer import CENTER, K, kmer_codes, scan
from pulsegrid.operators.motifs import Motif
from pulsegrid.shared import lookup, small_batches, unused, written

MOMENTS = ["n", "sum_ipd", "sum_ipd2", "sum_pw", "sum_pw2"]
SPACE = 4**K
SLICE = 1 << 18
CHUNK = 1 << 17  # keys of a batch that a kernel makes
INT64_MIN, INT64_MAX = int(np.iinfo(np.int64).min), np.iinfo(np.int64).max
CELLS = 1 << 22  # keys by groups over a cap that the driver takes
PARTS = 8  # pieces of input that a task takes one after the other where there are many
DENSE = 1 << 16  # windows of a slice from which on a task keeps a table of the whole k-mer space


def usable(reads: DataFrame) -> DataFrame:
    """Reads with a sequence of 11 bases or more and both signals (a read without widths is dropped, not an error)."""
    return small_batches(reads).where(F.col("seq").isNotNull() & (F.length("seq") >= K) & F.col("fi").isNotNull() & F.col("fp").isNotNull())


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(np.diff(lists.offsets.to_numpy()))))


def _slices(batches, seq: str = "seq"):
    """Batches cut to a bounded number of bases, so that kernels' temporaries stay small."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(seq)), 0).to_numpy().astype(np.int64)) if b.num_rows else []
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + SLICE)))
            yield b.slice(i, j - i)
            i = j


@dataclass(frozen=True)
class Packed:
    """Reads that kernels unpack themselves, so that neither letters nor signals are made row by row first.

    ``letters`` makes the reads' bases of a batch, ``signals`` both signals of reads of
    given lengths, each as flat values with offsets.
    """

    frame: DataFrame
    columns: tuple[str, ...]  # that both take, the text first
    letters: Callable[[pa.RecordBatch], list[bytes]]
    signals: Callable[[pa.RecordBatch, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _source(reads: DataFrame | Packed, keep: list[str]) -> tuple[DataFrame, str, Callable, Callable]:
    """The frame of ``keep`` and what kernels take, the column that says a read's size, and how letters and signals come from a batch."""
    if isinstance(reads, Packed):
        return small_batches(reads.frame).select(*dict.fromkeys([*keep, *reads.columns])), reads.columns[0], reads.letters, reads.signals
    src = usable(reads).select(*keep, "seq", F.col("fi").cast("array<int>").alias("fi"), F.col("fp").cast("array<int>").alias("fp"))
    return src, "seq", lambda b: [s.encode() for s in b.column("seq").to_pylist()], lambda b, lengths: (*_flat(b.column("fi")), *_flat(b.column("fp")))


def _windows(b: pa.RecordBatch, letters, signals, motifs: list[Motif], whole: bool = False):
    """(row, place, kmer, meth, ipd, pw) of every window; signals and mark are the centre's."""
    seqs = letters(b)
    lengths = np.array([len(s) for s in seqs], np.int64)
    ipd, i_off, pw, p_off = signals(b, lengths)
    off = np.concatenate(([0], np.cumsum(lengths)))
    buf = np.frombuffer(b"".join(seqs), np.uint8)
    least = np.minimum(lengths, np.minimum(np.diff(i_off), np.diff(p_off)))  # what all three have
    meth = scan(buf, off[:-1], off[:-1] + (lengths if whole else least), motifs)
    n = np.maximum(0, least - K + 1)
    rows = np.repeat(np.arange(len(seqs)), n)
    within = np.arange(int(n.sum())) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
    at = off[rows] + within
    codes = kmer_codes(buf)[at] if len(at) else np.zeros(0, np.int32)
    return rows, within, codes, meth[at + CENTER], ipd[i_off[rows] + within + CENTER], pw[p_off[rows] + within + CENTER]


def _sums(key: np.ndarray, ipd: np.ndarray, pw: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys in order, and the moments of each."""
    uniq, inverse = np.unique(key, return_inverse=True)
    ipd, pw = ipd.astype(float), pw.astype(float)
    return uniq, [np.bincount(inverse, weights=w, minlength=len(uniq)) for w in (None, ipd, ipd**2, pw, pw**2)]


def fewer(src: DataFrame) -> tuple[DataFrame, int]:
    """``src`` in fewer, larger tasks, and how many at most: each makes one table. Nothing is shuffled for it."""
    parts = max(1, src.rdd.getNumPartitions())
    n = min(parts, max(2 * src.sparkSession.sparkContext.defaultParallelism, -(-parts // PARTS)))
    return src.coalesce(n), n


def moments(reads: DataFrame | Packed, motifs: list[Motif], by: list[str] | None = None, scan_whole: bool = False) -> DataFrame:
    """(by, kmer, meth_id, n, sums and sums of squares of both signals).

    Without ``by``, a task adds all its unmarked windows in one table of the k-mer space
    and hands on a row per k-mer; else Python sums each slice's windows.  The JVM combines
    them before one shuffle on the key.  ``scan_whole`` marks motifs on the whole read, not
    only on the part that has signals.
    """
    by = by or []
    src, text, letters, signals = _source(reads, by)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema if f.name in by)

    def made(own: list, kmer: np.ndarray, meth: np.ndarray, sums: list[np.ndarray]) -> pa.RecordBatch:
        cols = [pa.array(kmer.astype(np.int32)), pa.array(meth.astype(np.int32)), pa.array(sums[0].astype(np.int64))] + [pa.array(s.astype(float)) for s in sums[1:]]
        return pa.RecordBatch.from_arrays(own + cols, names=[*by, "kmer", "meth_id", *MOMENTS])

    def grouped(batches):
        for b in _slices(batches, text):
            rows, _, codes, meth, ipd, pw = _windows(b, letters, signals, motifs, scan_whole)
            keys = pa.StructArray.from_arrays([b.column(c) for c in by], names=by).to_pylist()
            table = {repr(k): i for i, k in reversed(list(enumerate(keys)))}
            group = np.array([table[repr(k)] for k in keys], np.int64)[rows]
            uniq, sums = _sums((group * SPACE + codes) * 4 + meth, ipd, pw)
            take = pa.array(uniq // 4 // SPACE)
            yield made([b.column(c).take(take) for c in by], uniq // 4 % SPACE, uniq % 4, sums)

    def whole(batches):
        table = None
        for b in _slices(batches, text):
            _, _, codes, meth, ipd, pw = _windows(b, letters, signals, motifs, scan_whole)
            marked = np.flatnonzero(meth)
            if len(marked):
                uniq, sums = _sums(codes[marked].astype(np.int64) * 4 + meth[marked], ipd[marked], pw[marked])
                yield made([], uniq // 4, uniq % 4, sums)
            plain = np.flatnonzero(meth == 0)
            if len(plain) < DENSE and table is None:
                uniq, sums = _sums(codes[plain], ipd[plain], pw[plain])
                yield made([], uniq, np.zeros(len(uniq)), sums)
                continue
            if table is None:
                table = np.zeros((len(MOMENTS), SPACE))
            at, ipd, pw = codes[plain].astype(np.intp), ipd[plain].astype(float), pw[plain].astype(float)
            for sums, w in zip(table, (np.ones(len(at)), ipd, ipd * ipd, pw, pw * pw), strict=True):
                np.add.at(sums, at, w)
        for lo in range(0, SPACE if table is not None else 0, CHUNK):
            part = table[:, lo : lo + CHUNK]
            found = np.flatnonzero(part[0])
            if len(found):
                yield made([], lo + found, np.zeros(len(found)), list(part[:, found]))

    if not by and isinstance(reads, Packed):
        src, _ = fewer(src)
    part = src.mapInArrow(grouped if by else whole, fields + "kmer int, meth_id int, n bigint, sum_ipd double, sum_ipd2 double, sum_pw double, sum_pw2 double")
    return merge(part, by)


def merge(tables: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds up the moments of each key; also merges tables of several runs."""
    return tables.groupBy(*(by or []), "kmer", "meth_id").agg(*[F.sum(m).alias(m) for m in MOMENTS])


def kmers(reads: DataFrame) -> DataFrame:
    """(kmer, n): the windows of all sequences, whatever their signals; letters other than ACGT count as A."""

    def run(batches):
        for b in _slices(batches):
            seqs = [s.encode("ascii", "replace") for s in b.column("seq").to_pylist()]
            codes = kmer_codes(np.frombuffer(b"N".join(seqs), np.uint8))
            ends = np.cumsum([len(s) + 1 for s in seqs])
            inside = np.ones(len(codes), bool)  # windows that hold no separator
            for j in range(K):
                at = ends - 1 - j
                inside[at[(at >= 0) & (at < len(inside))]] = False
            found, n = np.unique(codes[inside], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(n.astype(np.int64))], names=["kmer", "n"])

    part = small_batches(reads).where(F.length("seq") >= K).select("seq").mapInArrow(run, "kmer int, n bigint")
    return part.groupBy("kmer").agg(F.sum("n").alias("n"))


def samples(reads: DataFrame | Packed, motifs: list[Motif], keep: list[str] | None = None, then: Callable | None = None, signal: str = "float") -> DataFrame:
    """(keep, pos, kmer, meth_id, ipd, pw): one row per window; ``pos`` is the window's start. ``then`` may make other signals, of another type, from batches of these rows."""
    keep = keep or []
    src, text, letters, signals = _source(reads, keep)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema if f.name in keep)

    def run(batches):
        for b in _slices(batches, text):
            rows, pos, codes, meth, ipd, pw = _windows(b, letters, signals, motifs)
            yield _sample_rows(b, keep, rows, pos, codes, meth, ipd, pw)

    whole = run if then is None else lambda batches: then(run(batches))
    return src.mapInArrow(whole, fields + f"pos int, kmer int, meth_id int, ipd {signal}, pw {signal}")


def _sample_rows(b: pa.RecordBatch, keep: list[str], rows, pos, codes, meth, ipd, pw) -> pa.RecordBatch:
    take = pa.array(rows)
    cols = [pa.array(x) for x in (pos.astype(np.int32), codes, meth.astype(np.int32), ipd.astype(np.float32), pw.astype(np.float32))]
    return pa.RecordBatch.from_arrays([b.column(c).take(take) for c in keep] + cols, names=[*keep, "pos", "kmer", "meth_id", "ipd", "pw"])


def marks(sequences: DataFrame, motifs: list[Motif], keep: list[str], seq: str = "seq") -> DataFrame:
    """(keep, pos, meth_id) of every marked base."""
    src = small_batches(sequences).where(F.col(seq).isNotNull()).select(*keep, F.col(seq).alias("_seq"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema if f.name in keep)

    def run(batches):
        for b in _slices(batches, "_seq"):
            seqs = [s.encode() for s in b.column("_seq").to_pylist()]
            off = np.concatenate(([0], np.cumsum([len(s) for s in seqs]))).astype(np.int64)
            meth = scan(np.frombuffer(b"".join(seqs), np.uint8), off[:-1], off[1:], motifs)
            at = np.flatnonzero(meth)
            rows = np.searchsorted(off, at, "right") - 1
            yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(rows)) for c in keep] + [pa.array(at - off[rows], pa.int64()), pa.array(meth[at].astype(np.int32))], names=[*keep, "pos", "meth_id"])

    return src.mapInArrow(run, fields + "pos bigint, meth_id int")


def _same(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str) -> DataFrame:
    """``left`` joined with the counted ``right`` on equal keys, nulls among them; without right's keys."""
    names = {k: unused(k, [*left.columns, *right.columns]) for k in keys}
    other = lookup(right.withColumnsRenamed(names))
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return left.join(other, on, how).drop(*names.values())


def cap(rows: DataFrame, limit: int, order: Column, keys: tuple[str, ...] = ("kmer", "meth_id")) -> DataFrame:
    """At most ``limit`` rows of each key, those of the lowest ``order``: hex digits of a hash of the row's identity, so a uniform sample that no retry changes.

    Keys of at most ``limit`` rows are counted only; their rows are neither moved nor sorted.
    Of all others, counts by the leading bits of the order say which rows can be among
    the lowest, so that a key is sorted with few more than ``limit`` rows, however many it has.
    """
    full = written(rows.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > limit).select(*keys), "full")
    if full.isEmpty():
        return rows
    bits, level, least, rank = (unused(x, rows.columns) for x in ("bits", "level", "least", "rank"))
    # the leading zeros of the first 32 bits: a row of a higher level is lower in order
    ranked = _same(rows, full, keys, "left_semi").withColumn(bits, F.conv(F.substring(order, 1, 8), 16, 10).cast("long")).withColumn(level, 32 - F.length(F.bin(bits))).drop(bits)
    seen = ranked.groupBy(*keys, level).agg(F.count("*").alias(rank))
    down = Window.partitionBy(*keys).orderBy(F.desc(level)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    enough = seen.withColumn(rank, F.sum(rank).over(down)).where(F.col(rank) >= limit).groupBy(*keys).agg(F.max(level).alias(least))
    hot = _same(ranked, written(enough, "enough"), keys, "inner").where(F.col(level) >= F.col(least)).drop(level, least)
    first = hot.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col(rank) <= limit).drop(rank)
    return _same(rows, full, keys, "left_anti").unionByName(first)


def _places(known: np.ndarray, codes: np.ndarray, meth: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows whose key is in ``known`` (sorted; ``hot`` says the same of the whole key space), and its place there."""
    key = codes.astype(np.intp) * 4 + meth
    at = np.flatnonzero(hot.take(key))
    return at, np.searchsorted(known, key[at])


def _is_in(known: np.ndarray) -> np.ndarray:
    hot = np.zeros(4 * SPACE, bool)
    hot[known] = True
    return hot


def _orders(b: pa.RecordBatch, heads: str, rows: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The first 16 hex digits of md5(read:place) as numbers in the same order."""
    words = decimal_md5([x.encode() for x in b.column(heads).to_pylist()], rows, pos)[0].astype(np.uint64)
    return ((words[0] << np.uint64(32) | words[1]) ^ np.uint64(1 << 63)).view(np.int64)


def _cut(share: np.ndarray) -> np.ndarray:
    """The order up to which a share of all lies."""
    return np.where(share < 1, share * 2.0**64 - 2.0**63, np.inf)


def capped_samples(reads: Packed, motifs: list[Motif], ident: str, group: str | None, limit: int, total: int) -> DataFrame:
    """(ident, pos, kmer, meth_id, ipd, pw): the windows, capped at ``limit`` a key and group, and what is left of these at ``total`` a key; those of the lowest md5(ident:pos) stay.

    Without a group, at the lower of both a key. The same rows as ``cap`` of ``cap`` of
    ``samples``, but no window is moved unless it is returned or may be the last one under
    a cap. Kernels count windows to find keys over a cap, then rank those of these whose
    order is near the place of the cap (those below are counted), which gives each such key
    the highest order that stays, and at last return windows up to it. Where equal orders
    meet at that place, or keys over a cap are too many for the driver, ``cap`` does it.
    """
    by_group = group is not None
    src, text, letters, signals = _source(reads, [ident, group] if by_group else [ident])
    if not by_group:
        group, limit = unused("group", src.columns), min(limit, total)
        src, total = src.withColumn(group, F.lit(0)), limit
    names = [unused(x, src.columns) for x in ("head", "key", "cell", "n", "over", "order", "r1", "r2", "lives", "rows")]
    head, key, cell, n, over, order, r1, r2, lives, count = names
    src = src.withColumn(head, F.concat_ws(":", F.col(ident).cast("string"), F.lit("")))
    few, tasks = fewer(src)
    kind, arrow = src.schema[group].dataType.simpleString(), to_arrow_type(src.schema[group].dataType)

    def plainly() -> DataFrame:
        by = F.md5(F.concat_ws(":", F.col(ident).cast("string"), F.col("pos").cast("string")))
        if not by_group:
            return cap(samples(reads, motifs, [ident]), limit, by)
        return cap(cap(samples(reads, motifs, [ident, group]), limit, by, ("kmer", "meth_id", group)).drop(group), total, by)

    def frequent(batches):
        table = np.zeros(4 * SPACE, np.int32)
        for b in _slices(batches, text):
            _, _, codes, meth, _, _ = _windows(b, letters, signals, motifs)
            np.add.at(table, codes.astype(np.intp) * 4 + meth, np.int32(1))
        for lo in range(0, len(table), CHUNK):  # a key over the cap is over its share of it in one task at least
            found = lo + np.flatnonzero(table[lo : lo + CHUNK] > min(limit, total) // tasks)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found)], names=[key])

    keys = few.mapInArrow(frequent, f"`{key}` bigint").distinct().toArrow().column(0).to_numpy()
    if not len(keys):
        return samples(reads, motifs, [ident])
    sent = src.sparkSession.sparkContext.broadcast(np.sort(keys))

    def counted(batches):
        known = sent.value
        hot, tables = _is_in(known), {}
        for b in _slices(batches, text):
            rows, _, codes, meth, _, _ = _windows(b, letters, signals, motifs)
            at, place = _places(known, codes, meth, hot)
            edges = np.searchsorted(rows[at], np.arange(b.num_rows + 1))
            for i, g in enumerate(b.column(group).to_pylist()):
                if edges[i] < edges[i + 1]:
                    np.add.at(tables.setdefault(g, np.zeros(len(known), np.int64)), place[edges[i] : edges[i + 1]], np.int64(1))
        for g, table in tables.items():
            found = np.flatnonzero(table)
            for lo in range(0, len(found), CHUNK):
                own = found[lo : lo + CHUNK]
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(own), arrow), pa.array(known[own]), pa.array(table[own])], names=[group, key, n])

    cells = few.mapInArrow(counted, f"`{group}` {kind}, `{key}` bigint, `{n}` bigint").groupBy(group, key).agg(F.sum(n).alias(n))
    per_key = Window.partitionBy(key)
    cells = cells.withColumn(over, F.sum(F.least(n, F.lit(limit))).over(per_key) > total).where(F.col(over) | (F.col(n) > limit))
    got = cells.limit(CELLS + 1).toArrow()
    if got.num_rows > CELLS:
        return plainly()
    if not got.num_rows:
        return samples(reads, motifs, [ident])
    # rows of keys over a cap by groups: how many windows, and the order up to which they are ranked
    labels, at = np.unique(got.column(key).to_numpy(), return_inverse=True)
    groups = {g: j for j, g in enumerate(dict.fromkeys(got.column(group).to_pylist()))}
    column = np.array([groups[g] for g in got.column(group).to_pylist()])
    size = np.zeros((len(labels), len(groups)))
    size[at, column] = got.column(n).to_numpy()
    both = np.zeros(len(labels), bool)
    both[at[got.column(over).to_numpy()]] = True
    full = size > limit
    low, high = np.zeros(len(labels)), np.ones(len(labels))
    for _ in range(50):  # the share of all orders under which ``total`` of those that stay lie
        middle = (low + high) / 2
        enough = np.minimum(size * middle[:, None], limit).sum(1) >= total
        low, high = np.where(enough, low, middle), np.where(enough, middle, high)
    # the place of the cap deviates by the square root of the cap; ranks are checked, so a miss is seen
    spread = 6 * limit**0.5 + 12
    least, most = ((limit + x) / np.maximum(size, 1) for x in (-spread, spread))
    cut = np.where(full, _cut(most), np.where(both[:, None], _cut(high * 1.1)[:, None], -np.inf))
    below = np.where(full & ~both[:, None] & (least > 0), _cut(least), -np.inf)
    ranked = src.sparkSession.sparkContext.broadcast((labels, groups, cut, below, full, both))

    def lowest(batches):
        labels, groups, cut, below, full, both = ranked.value
        hot, lower = _is_in(labels), np.zeros(cut.size, np.int64)

        def made(place, column, value, rows):
            return pa.RecordBatch.from_arrays([pa.array(place * len(groups) + column), pa.array(place), pa.array(full[place, column]), pa.array(both[place]), pa.array(value), pa.array(rows)], names=[cell, key, lives, over, order, count])

        for b in _slices(batches, text):
            rows, pos, codes, meth, _, _ = _windows(b, letters, signals, motifs)
            at, place = _places(labels, codes, meth, hot)
            column = np.array([groups.get(g, -1) for g in b.column(group).to_pylist()])[rows[at]]
            use = (column >= 0) & (cut[place, column] > -np.inf)
            at, place, column = at[use], place[use], column[use]
            value = _orders(b, head, rows[at], pos[at])
            use = value <= below[place, column]
            np.add.at(lower, place[use] * len(groups) + column[use], np.int64(1))
            use = ~use & (value <= cut[place, column])
            yield made(place[use], column[use], value[use], np.ones(int(use.sum()), np.int64))
        found = np.flatnonzero(lower)
        for lo in range(0, len(found), CHUNK):  # a row for all that are lower
            own = found[lo : lo + CHUNK]
            yield made(own // len(groups), own % len(groups), np.full(len(own), INT64_MIN), lower[own])

    ranks = few.mapInArrow(lowest, f"`{cell}` bigint, `{key}` bigint, `{lives}` boolean, `{over}` boolean, `{order}` bigint, `{count}` bigint")
    so_far = Window.partitionBy(cell).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = ranks.withColumnRenamed(lives, n).withColumn(r1, F.sum(count).over(so_far))  # n: the group itself is over its cap
    last = F.col(n) & F.col(r1).isin(limit, limit + 1) & (F.col(order) > INT64_MIN)
    stays = F.col(over) & (~F.col(n) | (F.col(r1) <= limit))
    if both.any():
        ranks = ranks.withColumn(lives, stays).withColumn(r2, F.when(F.col(lives), F.row_number().over(Window.partitionBy(key, lives).orderBy(order))))
    else:
        ranks = ranks.withColumn(lives, F.lit(False)).withColumn(r2, F.lit(None).cast("int"))
    ends = ranks.where(last | F.col(r2).isin(total, total + 1)).select(cell, key, n, r1, r2, order).collect()  # two rows a key and group over its cap
    first, second = np.full((*cut.shape, 2), INT64_MAX), np.full((len(labels), 2), INT64_MAX)
    seen = [0, 0]
    for c, k, own, i, j, value in ends:
        if own and limit <= i <= limit + 1:
            first[k, c % len(groups), i - limit] = value
            seen[0] += 1
        if j is not None and total <= j <= total + 1:
            second[k, j - total] = value
            seen[1] += 1
    if seen != [2 * full.sum(), 2 * both.sum()] or (first[..., 0] == first[..., 1])[full].any() or (second[:, 0] == second[:, 1])[both].any():
        return plainly()
    # a group that is not among those over a cap keeps all its windows
    last_order = np.minimum(first[..., 0], second[:, :1])
    ends_at = src.sparkSession.sparkContext.broadcast((labels, groups, last_order))

    def kept(batches):
        labels, groups, last_order = ends_at.value
        hot = _is_in(labels)
        for b in _slices(batches, text):
            rows, pos, codes, meth, ipd, pw = _windows(b, letters, signals, motifs)
            at, place = _places(labels, codes, meth, hot)
            column = np.array([groups.get(g, -1) for g in b.column(group).to_pylist()])[rows[at]]
            use = (column >= 0) & (last_order[place, column] < INT64_MAX)
            at, least = at[use], last_order[place[use], column[use]]
            stay = np.ones(len(rows), bool)
            stay[at] = _orders(b, head, rows[at], pos[at]) <= least
            cols = (rows, pos, codes, meth, ipd, pw)
            yield _sample_rows(b, [ident], *(cols if stay.all() else (x[stay] for x in cols)))

    fields = f"`{ident}` {src.schema[ident].dataType.simpleString()}, "
    return src.mapInArrow(kept, fields + "pos int, kmer int, meth_id int, ipd float, pw float")


def coverage(table: DataFrame) -> DataFrame:
    """Entries, share of the k-mer space, and mean, median, least, most and total observations per methylation state."""
    return _coverage(table.groupBy("meth_id"))


def coverage_combined(table: DataFrame) -> DataFrame:
    """The same over all methylated entries; counts (k-mer, state) pairs."""
    return _coverage(table.where("meth_id <> 0").groupBy())


def _coverage(groups) -> DataFrame:
    return groups.agg(
        F.count("*").alias("entries"), (F.count("*") * 100.0 / SPACE).alias("pct"), F.avg("n").alias("mean_n"), F.median("n").alias("median_n"), F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.sum("n").alias("total_n")
    )


def strain_stats(reads: DataFrame, strain: str = "strain") -> DataFrame:
    """Mean and population deviation over all of a strain's signals (both strands), rounded to four places; 0 where there are none."""
    both = lambda a, b: F.concat(F.coalesce(a, F.array().cast("array<int>")), F.coalesce(b, F.array().cast("array<int>")))
    one = lambda c, f: F.aggregate(c, F.lit(0).cast("long"), f)
    r = reads.select(strain, both("fi", "ri").alias("i"), both("fp", "rp").alias("p"))
    r = r.select(strain, *[x for c in "ip" for x in (F.size(c).cast("long").alias(f"n{c}"), one(c, lambda a, x: a + x).alias(f"s{c}"), one(c, lambda a, x: a + x * x).alias(f"q{c}"))])
    g = r.groupBy(strain).agg(*[F.sum(f"{k}{c}").alias(f"{k}{c}") for c in "ip" for k in "nsq"])
    mean = lambda c: F.when(F.col(f"n{c}") == 0, 0.0).otherwise(F.round(F.col(f"s{c}") / F.col(f"n{c}"), 4))
    dev = lambda c: F.when(F.col(f"n{c}") == 0, 0.0).otherwise(F.round(F.sqrt(F.greatest(F.lit(0.0), F.col(f"q{c}") / F.col(f"n{c}") - (F.col(f"s{c}") / F.col(f"n{c}")) * (F.col(f"s{c}") / F.col(f"n{c}")))), 4))
    return g.select(strain, mean("i").alias("mean_ipd"), dev("i").alias("std_ipd"), mean("p").alias("mean_pw"), dev("p").alias("std_pw"))


def strain_bars(stats: DataFrame, strain: str = "strain") -> DataFrame:
    """What bar charts of the strains' statistics show: the last part of a strain's dotted name, means, and deviations as error bars."""
    return stats.select(F.element_at(F.split(F.col(strain), r"\."), -1).alias("label"), "mean_ipd", "std_ipd", "mean_pw", "std_pw")
