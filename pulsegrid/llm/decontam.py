"""Benchmark decontamination by template canonicalisation.

Texts are read as templates: numbers, names and units become typed placeholders,
all other words their lower-cased cores.  The windows of template tokens of all
benchmark items form one table, (key, item, place), those of the documents another,
and both are joined by key.  Where windows meet, the values in their slots are
compared; windows of few literal words meet only with equal values.  An item leaks
into a text if windows cover enough of it, or a long run in one piece, and each slot
value of the item meets one value throughout, the same (a plain copy) or another (a
question with new parameters).

1. *Items*: their windows, written.  A bitmap of fixed size holds their keys.
2. *Texts*: one pass over the documents keeps the windows whose keys are in the
   bitmap; copies of a text are merged before anything else moves.
3. *Join* by key, by broadcast only where the items' windows are few by count.
4. *Decision*: the matches of a text and an item are streamed in order past a state
   as large as the item.  Nothing of a text but its matched windows is shuffled.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, unused, written
from .textkernel import EXACT, U64, Words, bytes_of, fold_latin, mix, slices, span_hashes, window_hashes

# Words that are units when they follow a number.
UNITS = "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ml cl l liter liters litre litres gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years eur euro euros usd dollar dollars cent cents percent degree degrees mph kmh kb mb gb tb hz khz mhz ghz w kw v a j kj pa".split()

WINDOW = 8  # template tokens
LITERALS = 4  # words of a window that must not be placeholders, or else the slot values must be the same
SHORTEST = 4  # items of fewer tokens leak by the same words only
COVER = 0.6  # least share of an item's tokens in matched windows
RUN = 40  # tokens matched in one piece that count as a leak whatever their share
CONSISTENT = 0.75  # least share of an item's slot values that meet one value throughout
LOOKUP_ROWS = 200_000  # rows up to which a table is broadcast; beyond, joins shuffle
FILTER_BITS = 28  # the filter of window keys has 2 ** this many bits at most

NUM, NAME, UNIT = U64(0x1111111111111111), U64(0x2222222222222222), U64(0x3333333333333333)


def _unit_keys() -> np.ndarray:
    out = []
    for u in UNITS:
        b = np.frombuffer(u.encode(), np.uint8)
        out.append(span_hashes(b, np.array([0]), np.array([len(b)]), EXACT)[0])
    return np.sort(np.array(out, U64))


_UNITS = _unit_keys()


@dataclass
class Templates:
    """Template tokens of a slice: ``kind`` (0 word, 1 number, 2 name, 3 unit), ``value`` (hash of the core), ``token`` (what windows see), ``first`` per row.

    ``kinds`` and ``tokens`` are the other reading, in which every capitalised word is a name, wherever it stands.
    """

    kind: np.ndarray
    value: np.ndarray
    token: np.ndarray
    first: np.ndarray
    kinds: np.ndarray
    tokens: np.ndarray


def canonical(buf: np.ndarray, off: np.ndarray) -> Templates:
    """Tokens are the words that hold a letter or digit; ASCII punctuation around them is dropped.

    Number: holds a digit.  Unit: a known unit right after a number.  Name: starts with
    a capital, has small letters, and neither starts a text or line nor follows [.!?:].
    As a word may stand so in one text and not in the other, windows are also read
    with all capitalised words as names, and with all tokens as they are.
    """
    words = Words(buf, off)
    lo, hi = words.cores()
    keep = hi > lo
    row = words.row()[keep]
    first = np.searchsorted(row, np.arange(len(words.n) + 1))
    starts, ends, lo, hi = words.starts[keep], words.ends[keep], lo[keep], hi[keep]
    if not len(lo):
        none = np.zeros(0, np.int8)
        return Templates(none, np.zeros(0, U64), np.zeros(0, U64), first, none, np.zeros(0, U64))
    sums = lambda flags: np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    digits, small = sums((buf >= 48) & (buf <= 57)), sums(((buf >= 97) & (buf <= 122)) | (buf >= 128))
    value = span_hashes(fold_latin(buf), lo, hi, EXACT)
    kind = np.zeros(len(lo), np.int8)
    number = digits[hi] > digits[lo]
    head, nxt = buf[lo], buf[np.minimum(lo + 1, len(buf) - 1)]
    capital = ((head >= 65) & (head <= 90)) | ((head == 0xC3) & (nxt >= 0x80) & (nxt <= 0x9E))
    named = capital & (small[hi] - small[np.minimum(lo + 1 + (head == 0xC3), hi)] > 0)
    opens = np.ones(len(lo), bool)
    if len(lo) > 1:
        lines = sums(buf == 10)
        stop = np.isin(buf[ends[:-1] - 1], np.frombuffer(b".!?:", np.uint8))
        opens[1:] = stop | (lines[starts[1:]] != lines[ends[:-1]]) | (row[1:] != row[:-1])
        after = np.zeros(len(lo), bool)
        after[1:] = number[:-1] & (row[1:] == row[:-1])
        at = np.minimum(np.searchsorted(_UNITS, value), len(_UNITS) - 1)
        kind[after & (_UNITS[at] == value)] = 3
    kinds = np.where(named, 2, kind).astype(np.int8)
    kind[named & ~opens] = 2
    kind[number] = kinds[number] = 1
    seen = lambda k: np.where(k == 0, value, np.choose(k, [U64(0), NUM, NAME, UNIT]))
    return Templates(kind, value, seen(kind), first, kinds, seen(kinds))


def template_windows(t: Templates, size: int, item: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, first tokens, kinds of all tokens) of all windows of ``size`` tokens within one row, for each reading.

    Both template readings share their keys, so that a window meets another under either
    reading of both; a window that is the same in both comes once.  Windows with their
    values have keys of their own.  Of an item, template windows of few literals are left out.
    """
    n = np.maximum(0, np.diff(t.first) - size + 1)
    at = np.arange(int(n.sum())) + np.repeat(t.first[:-1] - (np.cumsum(n) - n), n)
    if not len(at):
        return
    seen = None
    for reading, (tokens, kind) in enumerate(((t.token, t.kind), (t.tokens, t.kinds), (t.value, t.kind))):
        exact = reading == 2
        if size < SHORTEST and not exact:
            continue
        keys, own = window_hashes(tokens, size)[at], at
        if reading == 1:
            new = np.flatnonzero(keys != seen)
            keys, own = keys[new], at[new]
        elif reading == 0:
            seen = keys
        if item and not exact:
            words = np.concatenate(([0], np.cumsum(kind == 0)))
            use = words[own + size] - words[own] >= min(LITERALS, size)
            keys, own = keys[use], own[use]
        yield mix(keys + U64(2 * size + exact)), own, kind


@dataclass
class Match:
    """What the matched windows of one item in one text add up to; they come ordered by shift, place in the item, and slots."""

    length: int
    covered: np.ndarray = field(init=False)
    places: set = field(default_factory=set)
    meets: dict = field(default_factory=lambda: defaultdict(Counter))
    last: tuple = (None, None)
    run: tuple = (0, 0)  # the present piece of the item
    longest: int = 0

    def __post_init__(self):
        self.covered = np.zeros(self.length, bool)

    def add(self, p: int, q: int, kinds: bytes, item: np.ndarray, text: np.ndarray) -> None:
        """A window at ``p`` of the text and ``q`` of the item, with its kinds and both sides' values."""
        if (p - q, q) == self.last:
            return  # the same place under another reading, with more slots
        size = len(kinds)
        self.run = (self.run[0], q + size) if self.last[0] == p - q and q <= self.run[1] else (q, q + size)
        self.last = (p - q, q)
        self.longest = max(self.longest, self.run[1] - self.run[0])
        self.covered[q : q + size] = True
        self.places.add(q)
        for k, kind in enumerate(kinds):
            if kind:
                self.meets[kind, int(item[k])][int(text[k])] += 1

    def leak(self) -> tuple[int, float, bool] | None:
        """(matched windows, share of the item covered, whether slot values differ), or None."""
        share = float(self.covered.mean())
        if share < COVER and self.longest < RUN:
            return None
        # a slot value must meet one value; where a text holds the item twice, its commonest partner may share half
        steady = sum(c.most_common(1)[0][1] * 2 > sum(c.values()) or value in c for (_, value), c in self.meets.items())
        if self.meets and steady < CONSISTENT * len(self.meets):
            return None
        return len(self.places), share, any(value not in c for (_, value), c in self.meets.items())


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """Written (iid, item_id, text): a number for each row, so that repeated rows stay apart."""
    return written(benchmark.select(F.monotonically_increasing_id().alias("iid"), F.col(item_id).alias("item_id"), F.col(text).alias("text")), "items")


def _rows(parts: list[tuple], t: Templates, size_of: list[int]) -> tuple[np.ndarray, ...]:
    """Rows, places and fixed-width bytes (values of WINDOW tokens, the spare ones 0) of windows found."""
    at = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
    row = np.searchsorted(t.first, at, "right") - 1
    values = np.zeros((len(at), WINDOW), U64)
    lo = 0
    for (_, own, _), size in zip(parts, size_of, strict=True):
        values[lo : lo + len(own), :size] = t.value[own[:, None] + np.arange(size)]
        lo += len(own)
    return row, at - t.first[row], values


def _windows(items: DataFrame) -> DataFrame:
    """Written (key, iid, length, q, kinds, own) of the items' windows, and their sizes."""

    def run(batches):
        for part, buf, off in slices(batches, "text"):
            t = canonical(buf, off)
            lengths = np.diff(t.first)
            parts, sizes = [], []
            for size in range(1, WINDOW + 1):
                fits = lengths == size if size < WINDOW else lengths >= WINDOW
                for keys, at, kinds in template_windows(t, size, True):
                    keep = fits[np.searchsorted(t.first, at, "right") - 1]
                    parts.append((keys[keep], at[keep], kinds[at[keep][:, None] + np.arange(size)]))
                    sizes.append(size)
            row, q, values = _rows(parts, t, sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([p[0] for p in parts] or [np.zeros(0, U64)]).view(np.int64)), part.column("iid").take(pa.array(row)), pa.array(lengths[row], pa.int64()), pa.array(q, pa.int64()),
                    pa.array([k.astype(np.uint8).tobytes() for p in parts for k in p[2]], pa.binary()), pa.array([v.tobytes() for v in values], pa.binary()),
                ],
                names=["key", "iid", "length", "q", "kinds", "own"],
            )

    return written(items.select("iid", "text").mapInArrow(run, "key bigint, iid bigint, length bigint, q bigint, kinds binary, own binary"), "windows")


_CHUNK = 1 << 13  # bytes of the filter in a row


def _shifts(bits: int) -> list[U64]:
    """Where in a key the four places start that it has in a filter of 2 ** bits bits."""
    return [U64(s) for s in (0, 11, 23, 64 - bits)]


def _filter(windows: DataFrame, rows: int) -> tuple[int, np.ndarray]:
    """(bits, bitmap): about 32 bits a key, 2 ** FILTER_BITS at most, so its size is bounded whatever the benchmark's. It only spares the join keys that no item has."""
    bits = min(FILTER_BITS, max(17, (32 * rows).bit_length()))

    def fill(batches):
        out = np.zeros(1 << (bits - 3), np.uint8)
        for b in batches:
            for shift in _shifts(bits):
                at = (b.column("key").to_numpy().view(U64) >> shift) & U64((1 << bits) - 1)
                np.bitwise_or.at(out, (at >> U64(3)).astype(np.int64), np.left_shift(1, (at & U64(7)).astype(np.uint8)).astype(np.uint8))
        chunks = [k for k in range(0, len(out), _CHUNK) if out[k : k + _CHUNK].any()]
        yield pa.RecordBatch.from_arrays([pa.array([k // _CHUNK for k in chunks], pa.int64()), pa.array([out[k : k + _CHUNK].tobytes() for k in chunks], pa.binary())], names=["chunk", "bits"])

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column("chunk").to_pylist(), b.column("bits").to_pylist(), strict=True):
                held[k] = held.get(k, 0) | np.frombuffer(x, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.astype(np.uint8).tobytes() for x in held.values()], pa.binary())], names=["chunk", "bits"])

    made = windows.select("key").mapInArrow(fill, "chunk bigint, bits binary").repartition("chunk").mapInArrow(merge, "chunk bigint, bits binary")
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in made.collect():  # 2 ** (FILTER_BITS - 3) bytes at most
        out[r["chunk"] * _CHUNK : (r["chunk"] + 1) * _CHUNK] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return bits, out


def _text_windows(texts: DataFrame, known: tuple[int, np.ndarray], sizes: list[int]) -> DataFrame:
    """(tk, key, p, met): windows of the texts whose keys the filter holds; copies of a text give the same rows, which merge here."""
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        bits, bitmap = shared.value
        for part, buf, off in slices(batches, "text"):
            t = canonical(buf, off)
            parts, of = [], []
            for size in sizes:
                for keys, at, _ in template_windows(t, size, False):
                    hit = np.arange(len(keys))
                    for shift in _shifts(bits):
                        place = (keys[hit] >> shift) & U64((1 << bits) - 1)
                        hit = hit[(bitmap[(place >> U64(3)).astype(np.int64)] >> (place & U64(7)).astype(np.uint8)) & 1 == 1]
                    parts.append((keys[hit], at[hit], None))
                    of.append(size)
            row, p, values = _rows(parts, t, of)
            yield pa.RecordBatch.from_arrays(
                [part.column("tk").take(pa.array(row)), pa.array(np.concatenate([x[0] for x in parts] or [np.zeros(0, U64)]).view(np.int64)), pa.array(p, pa.int64()), pa.array([v.tobytes() for v in values], pa.binary())],
                names=["tk", "key", "p", "met"],
            )

    return texts.mapInArrow(run, "tk binary, key bigint, p bigint, met binary").distinct()


def _key(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def _found(docs: DataFrame, text: str, benchmark: DataFrame, item_id: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """Written tables: (tk, iid, n_windows, coverage, reparameterised) of every text into which an item leaks, and the items."""
    items = _items(benchmark, item_id, item_text)
    windows = _windows(items)
    stats = windows.groupBy(F.length("kinds").alias("size")).count().collect()  # WINDOW rows at most
    rows = sum(r["count"] for r in stats)
    hits = _text_windows(docs.select(_key(text).alias("tk"), F.col(text).alias("text")), _filter(windows, rows), sorted(r["size"] for r in stats))
    few = F.broadcast(windows) if rows <= LOOKUP_ROWS else windows
    met = hits.join(few, "key").select("tk", "iid", (F.col("p") - F.col("q")).alias("shift"), "q", F.length(F.translate(F.hex("kinds"), "0", "")).alias("slots"), "length", "kinds", "own", "met")
    dealt = met.repartition("tk", "iid").sortWithinPartitions("tk", "iid", "shift", "q", "slots", "kinds")

    def decide(batches):
        key, match = None, None
        names = ["tk", "iid", "n_windows", "coverage", "reparameterised"]

        def rows(found):
            cols = list(zip(*found, strict=True)) if found else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()), strict=True)], names=names)

        for b in batches:
            found = []
            cols = [b.column(c).to_pylist() for c in ("tk", "iid", "shift", "q", "length", "kinds", "own", "met")]
            for tk, iid, shift, q, length, kinds, own, text_values in zip(*cols, strict=True):
                if key != (tk, iid):
                    if match and (got := match.leak()):
                        found.append((*key, *got))
                    key, match = (tk, iid), Match(length)
                match.add(shift + q, q, kinds, np.frombuffer(own, U64), np.frombuffer(text_values, U64))
            yield rows(found)
        if match and (got := match.leak()):
            yield rows([(*key, *got)])

    out = written(dealt.mapInArrow(decide, "tk binary, iid bigint, n_windows bigint, coverage double, reparameterised boolean"), "leaks")
    drop(windows)
    return out, items


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and leaked item: doc_id, item_id, n_windows, coverage, reparameterised.

    Null and empty texts and items leak nothing.  Items of fewer than four tokens, one
    word even, leak wherever their words stand in this order.  Repeated rows of either
    table each get their rows.  Ids may be of any type; other columns play no part.
    """
    found, items = _found(docs, text, benchmark, item_id, item_text)
    few = lambda df: F.broadcast(df) if df.count() <= LOOKUP_ROWS else df
    src = docs.select(F.col(doc_id).alias("doc_id"), _key(text).alias("tk"))
    return src.join(few(found), "tk").join(few(items.select("iid", "item_id")), "iid").select("doc_id", "item_id", "n_windows", "coverage", "reparameterised")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents into which no item leaks, with all their columns. A row is judged by its own text; null and empty texts stay."""
    found, items = _found(docs, text, benchmark, item_id, item_text)
    bad = written(found.select("tk").distinct(), "leaked")
    drop(found, items)
    key = unused("tk", docs.columns)
    bad = bad.withColumnRenamed("tk", key)
    return docs.withColumn(key, _key(text)).join(F.broadcast(bad) if bad.count() <= LOOKUP_ROWS else bad, key, "left_anti").select(*docs.columns)


class Index:
    """The same decision for texts at hand, without Spark."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.ids = [i for i, _ in items]
        self.t = canonical(*bytes_of(pa.array([x or "" for _, x in items], pa.string())))
        self.windows: dict[int, list[tuple[int, int, bytes]]] = defaultdict(list)
        lengths, self.sizes = np.diff(self.t.first), set()
        for size in range(1, WINDOW + 1):
            for keys, at, kinds in template_windows(self.t, size, True):
                row = np.searchsorted(self.t.first, at, "right") - 1
                for key, a, k, kind in zip(keys.tolist(), at.tolist(), row.tolist(), kinds[at[:, None] + np.arange(size)], strict=True):
                    if lengths[k] == size or size == WINDOW:
                        self.sizes.add(size)
                        self.windows[key].append((k, a, kind.astype(np.uint8).tobytes()))

    def leaks(self, buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int, float, bool]]:
        """(row, item, matched windows, share of the item covered, whether slot values differ) of every leak in a slice."""
        t, met = canonical(buf, off), []
        for size in sorted(self.sizes):
            for keys, at, _ in template_windows(t, size, False):
                row = np.searchsorted(t.first, at, "right") - 1
                for key, p, r in zip(keys.tolist(), at.tolist(), row.tolist(), strict=True):
                    for k, a, kinds in self.windows.get(key, ()):
                        p0, q = p - int(t.first[r]), a - int(self.t.first[k])
                        met.append((r, k, p0 - q, q, sum(x > 0 for x in kinds), p, a, kinds))
        found: dict[tuple[int, int], Match] = {}
        for r, k, shift, q, _, p, a, kinds in sorted(met):
            m = found.setdefault((r, k), Match(int(self.t.first[k + 1] - self.t.first[k])))
            m.add(shift + q, q, kinds, self.t.value[a : a + len(kinds)], t.value[p : p + len(kinds)])
        for (r, k), m in found.items():
            if got := m.leak():
                yield r, k, *got
