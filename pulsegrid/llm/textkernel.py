"""Vectorised byte kernels over Arrow string columns.

Spark hands text to Python as Arrow batches; every kernel here works on the
UTF-8 bytes of a whole slice of a batch at once, so that no Python statement
runs per word.  A word is a maximal run of bytes other than space and 09-0D
(``[^\\x20\\x09-\\x0D]+``); nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
IS_WS = np.zeros(256, bool)
IS_WS[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that make up the core of a word: ASCII letters and digits, and all of any other script.
IS_CORE = np.zeros(256, bool)
IS_CORE[48:58] = IS_CORE[65:91] = IS_CORE[97:123] = IS_CORE[128:] = True

_BASE = 0x9E3779B97F4A7C13  # odd, 3 modulo 8
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(U64)
#: Byte values for hashes that ignore the case of A-Z, and for exact ones.
FOLDED, EXACT = _TABLE[LOWER], _TABLE
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = np.empty(size, U64)
        out[0], done = 1, 1
        while done < size:
            step = U64(pow(base, done, 1 << 64))
            out[done : 2 * done] = out[:done] * step
            done *= 2
        _powers[name] = have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def fold_latin(b: np.ndarray) -> np.ndarray:
    """Lower-cases A-Z and the Latin-1 capitals of UTF-8."""
    out = LOWER[b]
    if len(b) > 1:
        high = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)
        out = out.copy()
        out[1:][high] += 0x20
    return out


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets (int64, one more than rows) of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(batches, column: str, max_bytes: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of the batches in slices of about ``max_bytes`` of ``column`` (a longer text comes alone), with their bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = bytes_of(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + max_bytes, "right")) - 1)
            part = batch.slice(i, j - i)
            yield part, *bytes_of(part.column(column))
            i = j


class Words:
    """Spans of the words of a slice: ``starts``, ``ends``, and ``first``, the index of each row's first word (one more than rows)."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off = buf, off
        if not len(buf):
            self.starts = self.ends = np.zeros(0, np.int64)
        else:
            space = IS_WS[buf]
            before, after = np.ones(len(buf), bool), np.ones(len(buf), bool)
            before[1:], after[:-1] = space[:-1], space[1:]
            cut = off[1:-1]
            before[cut[cut < len(buf)]] = True
            after[cut[cut > 0] - 1] = True
            self.starts = np.flatnonzero(~space & before)
            self.ends = np.flatnonzero(~space & after) + 1
        self.first = np.searchsorted(self.starts, off)
        self.n = np.diff(self.first)

    def row(self) -> np.ndarray:
        """Row number of each word."""
        return np.repeat(np.arange(len(self.n)), self.n)

    def hashes(self, table: np.ndarray = FOLDED) -> np.ndarray:
        return span_hashes(self.buf, self.starts, self.ends, table)

    def cores(self) -> tuple[np.ndarray, np.ndarray]:
        """Spans of the words without leading and trailing ASCII punctuation; empty spans where nothing else is there."""
        if not len(self.starts):
            return self.starts, self.ends
        at = np.flatnonzero(IS_CORE[self.buf])
        at = np.append(at, len(self.buf))
        lo = at[np.searchsorted(at, self.starts)]
        hi_at = np.searchsorted(at, self.ends) - 1
        hi = np.where(hi_at >= 0, at[hi_at] + 1, 0)
        lo = np.minimum(lo, self.ends)
        return lo, np.maximum(lo, np.minimum(hi, self.ends))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = FOLDED, segment: int = 1 << 20) -> np.ndarray:
    """64-bit hash of each span (ascending, not overlapping); equal bytes give equal hashes wherever they stand."""
    out = np.empty(len(starts), U64)
    inverse = pow(_BASE, -1, 1 << 64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, lo + segment)))
        hi = max(int(ends[j - 1]), lo)
        sums = np.zeros(hi - lo + 1, U64)
        np.cumsum(table[buf[lo:hi]] * _power("up", _BASE, hi - lo), out=sums[1:])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[b] - sums[a]) * _power("down", inverse, hi - lo + 1)[a]
        i = j
    return mix(out + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes, rows not regarded; shorter by size - 1."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, U64)
    for j in range(size):
        out = out * U64(0xA0761D6478BD642F) + words[j : j + n]
    return mix(out)


def whole_windows(words: Words, size: int) -> np.ndarray:
    """Index of the first word of each window of ``size`` words that lies within one row."""
    n = np.maximum(0, words.n - size + 1)
    total = int(n.sum())
    shift = np.repeat(words.first[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
    return np.arange(total) + shift


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, sorted by row and hash; (hashes, index of each row's first, one more than rows).

    A row with fewer than ``size`` words, but one at least, has its whole sequence as one shingle.
    """
    h = words.hashes()
    at = whole_windows(words, size)
    rows = np.repeat(np.arange(len(words.n)), np.maximum(0, words.n - size + 1))
    vals = window_hashes(h, size)[at] if len(at) else np.zeros(0, U64)
    short = np.flatnonzero((words.n > 0) & (words.n < size))
    if len(short):
        own = np.empty(len(short), U64)
        for k, r in enumerate(short):
            own[k] = window_hashes(h[words.first[r] : words.first[r + 1]], int(words.n[r]))[0] ^ U64(words.n[r])
        rows, vals = np.concatenate((rows, short)), np.concatenate((vals, own))
    order = np.lexsort((vals, rows))
    rows, vals = rows[order], vals[order]
    keep = np.ones(len(vals), bool)
    keep[1:] = (vals[1:] != vals[:-1]) | (rows[1:] != rows[:-1])
    rows, vals = rows[keep], vals[keep]
    return vals, np.searchsorted(rows, np.arange(len(words.n) + 1))
