"""MD5 of many short keys at once: a text before a number in decimal digits and a text behind it."""

from __future__ import annotations

import hashlib
import math

import numpy as np

BLOCK = 8192  # keys whose state stays in a processor's cache; in smaller blocks, what a call itself costs counts
_K = [np.array(int(abs(math.sin(i + 1)) * 2**32), np.uint32) for i in range(64)]
_SHIFT = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_LEFT = [np.array(_SHIFT[i // 16][i % 4], np.uint32) for i in range(64)]
_RIGHT = [np.array(32 - _SHIFT[i // 16][i % 4], np.uint32) for i in range(64)]
_WORD = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _rounds(words: dict[int, np.ndarray], bits: int, out: np.ndarray) -> None:
    """The digests of one-block messages whose words other than ``words`` are 0, but for their length."""
    n = out.shape[1]
    xor, both_of, either, add, right, left, invert = np.bitwise_xor, np.bitwise_and, np.bitwise_or, np.add, np.right_shift, np.left_shift, np.invert
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, t, pair = (np.empty(n, np.uint32) for _ in range(3))
    for i in range(64):
        if i < 16:
            xor(c, d, f)
            both_of(f, b, f)
            xor(f, d, f)
        elif i < 32:
            xor(b, c, f)
            both_of(f, d, f)
            xor(f, c, f)
        elif i < 48:
            if i % 2:  # b ^ c of the step before is now c ^ d
                xor(b, pair, f)
            else:
                xor(b, c, pair)
                xor(pair, d, f)
        else:
            invert(d, f)
            either(f, b, f)
            xor(f, c, f)
        add(f, a, f)
        w = _WORD[i]
        if w in words:
            add(f, words[w], f)
        add(f, _K[i] + np.uint32(bits) if w == 14 else _K[i], f)
        right(f, _RIGHT[i], t)
        left(f, _LEFT[i], f)
        either(f, t, f)
        add(f, b, f)
        a, b, c, d, f = d, f, b, c, a
    for k, x in enumerate((a, b, c, d)[: len(out)]):
        add(x, np.uint32(_START[k]), out[k])


def decimal_md5(before: list[bytes], rows: np.ndarray, numbers: np.ndarray, behind: tuple[bytes, ...] = (b"",), words: int = 2) -> list[np.ndarray]:
    """For each text of ``behind``, the first ``words`` groups of eight hex digits of md5(before[row] + number + behind), as (words, n) unsigned numbers. Numbers are 0 or more."""
    outs = [np.empty((words, len(numbers)), np.uint32) for _ in behind]
    sizes = np.array([len(x) for x in before], np.int64)
    length = np.searchsorted(10 ** np.arange(1, 19, dtype=np.int64), numbers, "right") + 1
    kinds = sizes[rows] * 32 + length
    for kind in np.flatnonzero(np.bincount(kinds)) if len(kinds) and kinds.max() < 1 << 20 else np.unique(kinds):
        size, digits = divmod(int(kind), 32)
        whole = np.flatnonzero(kinds == kind)
        if size + digits + max(map(len, behind)) > 55:  # more than a block
            for out, text in zip(outs, behind, strict=True):
                for i in whole.tolist():
                    out[:, i] = np.frombuffer(hashlib.md5(before[rows[i]] + b"%d" % numbers[i] + text).digest(), ">u4")[:words]
            continue
        place = np.zeros(len(before), np.int64)
        own = np.flatnonzero(sizes == size)
        place[own] = np.arange(len(own))
        fixed = np.frombuffer(b"".join(before[i].ljust(64, b"\0") for i in own.tolist()), "<u4").reshape(-1, 16)
        for lo in range(0, len(whole), BLOCK):
            at = whole[lo : lo + BLOCK]
            row, rest = place[rows[at]], numbers[at].astype(np.uint32 if digits < 10 else np.uint64)
            common = {w: fixed[row, w] for w in range((size + 3) // 4)}
            for j in range(digits - 1, -1, -1):
                less = rest // 10
                digit = (rest - less * 10).astype(np.uint32) + np.uint32(48)
                w, shift = divmod(size + j, 4)
                digit <<= np.uint32(8 * shift)
                common[w] = common[w] | digit if w in common else digit
                rest = less
            for out, text in zip(outs, behind, strict=True):
                own_words = dict(common)
                for j, x in enumerate(text + b"\x80"):
                    w, shift = divmod(size + digits + j, 4)
                    own_words[w] = own_words.get(w, np.zeros(1, np.uint32)) + np.uint32(x << 8 * shift)
                part = np.empty((words, len(at)), np.uint32)
                _rounds(own_words, 8 * (size + digits + len(text)), part)
                out[:, at] = part.byteswap()
    return outs


def uniforms(words: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from groups of eight hex digits, as ``signal.uniform`` has them."""
    return (words.astype(float) + 0.5) / 4294967296.0


def normals(words: np.ndarray) -> np.ndarray:
    """Normal draws from the first two groups, as ``signal.normal`` has them."""
    u = uniforms(words[:2])
    return np.sqrt(-2.0 * np.log(u[0])) * np.cos(6.283185307179586 * u[1])
