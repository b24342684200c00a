"""Subword lattice likelihood of whole texts.

A word's probability is the marginal over all its segmentations into pieces of an
existing subword vocabulary, by a log-space forward recursion over the lattice of
matching pieces.  Pieces do not cross white space, so a document's lattice falls
apart at its words: the forward recursion runs once per distinct word of the
corpus, and a document's probability is the product over its words and its end.

The vocabulary's own scores are the first weights and stay as a Dirichlet prior;
expected piece counts over the training words (forward-backward, every word type
of the training texts) adapt them.  The lattice also has an arc for each whole
word of the training texts, weighted by its discounted count.  Corpora mix
languages and registers, so weights are kept per document class k, and the
marginal also runs over a document's class:

    P(doc)      = sum_k pi_k * P_k(end) * prod P_k(word)
    P_k(end)    = (docs_k + 1) / (N_k + docs_k + 2)
    P_k(word)   = (1 - P_k(end)) * (max(c_k - D_k, 0) + D_k * T_k * P_lattice_k(word)) / N_k

N_k: words, T_k: distinct words, D_k = n1 / (n1 + 2 n2).  Classes come without labels:
a multinomial mixture on at most ``CLASS_DOCS`` training texts only gives the start, then
rounds over all training texts assign each to its likeliest class and count its words
(in ``1 << BUCKET_BITS`` hashed buckets) anew.  Each training text counts in its class.
The box holds no unigram vocabulary; a merge-ranked one has ranks for scores, which
weigh as 1 / (rank + 10).  ``lattice_score`` is the marginal by the vocabulary's own
scores alone, without counts, adaptation and classes.

Counts are shuffled by word and grow with the corpus.  Words frequent enough to
be among ``FREQUENT`` (fixed) are scored from a broadcast table, all others by a join.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import held_out, lowest
from .scratch import drop, written
from .textkernel import LOWER, U64, Words, bytes_of, slices

FREQUENT = 1 << 17
CLASSES = 8
CLASS_DOCS, CLASS_WORDS, CLASS_CHARS = 3000, 3000, 20_000  # sample that the classes start from: texts, their commonest words, longest text
BUCKET_BITS = 15
CLASS_ROUNDS = 2  # over all training texts
PRIOR = 1000.0  # weight of the vocabulary's own scores, in pieces
LONG = 48  # bytes from which a word is solved on its own
STRETCH = 4096  # bytes of a long word whose arcs are held at once
MARK = "▁".encode()
_STEP = U64(0x9E3779B97F4A7C15)  # of the pieces' hashes
_LEAST = 1e-280  # scaled sums beyond this and its inverse are solved in the log domain


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def read_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces of a sentencepiece model and their log weights; byte pieces come last, as bytes <0xNN> in order."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    score = np.array([sp.get_score(i) for i in ids])
    ranked = len(score) > 1 and bool(np.all(score == np.round(score)))
    logp = -np.log(np.maximum(0, -score) + 10.0) if ranked else score
    pieces = [sp.id_to_piece(i).encode() for i in ids]
    logp = np.concatenate((logp, np.full(256, logp.min() - 1.0)))
    return pieces, logp - np.logaddexp.reduce(logp)


class Lattice:
    """Pieces with log weights; ``stop`` is the log probability that a word ends after a piece."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray, stop: float = math.log(0.4)):
        self.pieces, self.logp, self.stop = pieces, logp, stop
        size = np.array([len(p) for p in pieces])
        self.sizes, self.longest = set(size.tolist()), int(size.max())
        self.lengths = np.concatenate((size, np.ones(256, np.int64)))
        keys = np.zeros(len(pieces), U64)
        for n in self.sizes:
            own = np.flatnonzero(size == n)
            rows = np.frombuffer(b"".join(pieces[k] for k in own), np.uint8).reshape(-1, n)
            for j in range(n):
                keys[own] = (keys[own] + rows[:, j].astype(U64) + U64(1)) * _STEP
        # a hash table by the keys' leading bits; what meets a taken slot goes to the next one
        bits = max(4, (4 * len(pieces)).bit_length())
        self.shift, self.mask = U64(64 - bits), (1 << bits) - 1
        self.key, self.id = np.zeros(1 << bits, U64), np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(pieces)), (keys >> self.shift).astype(np.int64)
        while len(left):
            at, first = np.unique(slot[left], return_index=True)
            free = self.id[at] < 0
            put = left[first[free]]
            self.key[at[free]], self.id[at[free]] = keys[put], put
            left = np.setdiff1d(left, put)
            slot[left] = (slot[left] + 1) & self.mask

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces, and those pieces."""
        slot = (h >> self.shift).astype(np.int64)
        hit = self.key[slot] == h
        found = np.where(hit, self.id[slot], -1)
        more = np.flatnonzero(~hit & (self.id[slot] >= 0))
        while len(more):
            slot[more] = (slot[more] + 1) & self.mask
            here = self.key[slot[more]] == h[more]
            found[more[here]] = self.id[slot[more[here]]]
            more = more[~here & (self.id[slot[more]] >= 0)]
        at = np.flatnonzero(found >= 0)
        return at, found[at]

    def _arcs(self, rows: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows' numbers, pieces) of every match, for words of one length, ordered by start."""
        m, n = rows.shape
        cols, every = [rows[:, j].astype(U64) + U64(1) for j in range(n)], np.arange(m)
        out = []
        for s in range(n):
            h = np.zeros(m, U64)
            for e in range(s + 1, min(n, s + self.longest) + 1):
                h = (h + cols[e - 1]) * _STEP
                if e - s in self.sizes:
                    hit, ids = self._find(h)
                    if len(hit):
                        out.append((s, e, hit, ids))
            out.append((s, s + 1, every, len(self.pieces) + rows[:, s].astype(np.int64)))
        return out

    def _scaled(self, logp: np.ndarray, go: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights (a row per weighting) times a constant for each byte, which keeps products of up to LONG bytes within range, and the constants' logs."""
        each = -logp.min(1) / 2
        return np.exp(logp + go[:, None] + each[:, None] * self.lengths), each

    @staticmethod
    def _marginals(arcs, n: int, m: int, weights: np.ndarray) -> np.ndarray:
        """Scaled sums over all segmentations, a row per weighting."""
        alpha = np.zeros((n + 1, len(weights), m))
        alpha[0] = 1
        for s, e, r, k in arcs:  # alpha[s] is final when its arcs come
            if len(r) == m:
                alpha[e] += alpha[s] * weights[:, k]
            else:
                alpha[e][:, r] += alpha[s][:, r] * weights[:, k]
        return alpha[n]

    @staticmethod
    def _expect(arcs, n: int, kind: np.ndarray, weights: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Adds the expected pieces of words of n bytes, each under the weighting of its ``kind``; returns marks of the words that left the range, which it left out."""
        m = len(kind)
        alpha, beta = np.zeros((n + 1, m)), np.zeros((n + 1, m))
        alpha[0] = beta[n] = 1
        lps = [weights[kind[r], k] for _, _, r, k in arcs]
        for (s, e, r, _), lp in zip(arcs, lps, strict=True):
            alpha[e, r] += alpha[s, r] * lp
        for (s, e, r, _), lp in zip(reversed(arcs), reversed(lps), strict=True):
            beta[s, r] += beta[e, r] * lp
        bad = ~((alpha[n] > _LEAST) & (alpha[n] < 1 / _LEAST))
        total = np.where(bad, np.inf, alpha[n])
        w = np.concatenate([alpha[s, r] / total[r] * lp * beta[e, r] for (s, e, r, _), lp in zip(arcs, lps, strict=True)])
        at = np.concatenate([kind[r] * counts.shape[1] + k for _, _, r, k in arcs])
        if bad.any():
            w[~np.isfinite(w)] = 0
        counts += np.bincount(at, weights=w, minlength=counts.size).reshape(counts.shape)
        return bad

    def _ends(self, word: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, pieces, first): the arcs that end at each place of lo + 1..hi of a word, ordered by end; ``first`` counts them."""
        base = max(0, lo - self.longest)
        part, starts, ids, ends = word[base:hi], [], [], []
        h = np.zeros(len(part), U64)
        for n in range(1, min(self.longest, len(part)) + 1):  # h: hashes of the n bytes from each place on
            h = (h[: len(part) - n + 1] + part[n - 1 :].astype(U64) + U64(1)) * _STEP
            if n in self.sizes:
                hit, own = self._find(h)
                new = base + hit + n > lo
                starts.append(base + hit[new])
                ends.append(base + hit[new] + n)
                ids.append(own[new].astype(np.int64))
        single = np.arange(lo, hi)
        starts, ends, ids = (np.concatenate(x) for x in ([*starts, single], [*ends, single + 1], [*ids, len(self.pieces) + word[lo:hi].astype(np.int64)]))
        order = np.argsort(ends, kind="stable")
        return starts[order], ids[order], np.searchsorted(ends[order], np.arange(lo + 1, hi + 2))

    def _long(self, word: bytes, logp: np.ndarray, go: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
        """Log sums over all segmentations of a long word, one per weighting (rows of ``logp``); adds expected pieces to the rows of ``counts``.

        Arcs are held for a stretch of the word at a time, and the forward sums of a place
        only as long as arcs reach back to it, unless expectations are asked for.
        """
        b, step = np.frombuffer(word, np.uint8), (logp + go[:, None]).T
        n, whole = len(b), counts is not None
        held, base = np.zeros((1, len(logp))), 0  # forward sums from place ``base`` on
        add = lambda x: (top := x.max(0)) + np.log(np.exp(x - top).sum(0))
        for lo in range(0, n, STRETCH):
            hi = min(n, lo + STRETCH)
            starts, ids, first = self._ends(b, lo, hi)
            arcs, bounds = step[ids], first.tolist()
            own = np.concatenate((held, np.empty((hi - lo, len(logp)))))
            back = starts - base
            for e in range(hi - lo):
                i, j = bounds[e], bounds[e + 1]
                own[lo - base + 1 + e] = add(own[back[i:j]] + arcs[i:j])
            held = own if whole else own[-(self.longest + 1) :]
            base = hi + 1 - len(held)
        if whole:
            alpha, last = held, held[-1]
            beta = np.full((n + 1, len(logp)), -np.inf)
            beta[n] = 0
            for lo in reversed(range(0, n, STRETCH)):
                hi = min(n, lo + STRETCH)
                starts, ids, first = self._ends(b, lo, hi)
                arcs, bounds = step[ids], first.tolist()
                for e in range(hi - lo - 1, -1, -1):  # beta of a place is final when the arcs that end there come
                    i, j = bounds[e], bounds[e + 1]
                    np.logaddexp.at(beta, starts[i:j], beta[lo + 1 + e] + arcs[i:j])  # two pieces may span the same bytes
                ends = np.repeat(np.arange(lo + 1, hi + 1), np.diff(first))
                weight = np.exp(alpha[starts] + arcs + beta[ends] - last)
                for k in range(len(logp)):
                    counts[k] += np.bincount(ids, weights=weight[:, k], minlength=counts.shape[1])
        return held[-1]

    @staticmethod
    def _groups(words: list[bytes]):
        """Words of one length at a time, as (their numbers, bytes with the mark); long ones singly, as (number, bytes)."""
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            groups.setdefault(len(w), []).append(i)
        for n, ids in groups.items():
            if n >= LONG:
                yield from ((i, MARK + words[i]) for i in ids)
                continue
            for lo in range(0, len(ids), 8192):
                some = ids[lo : lo + 8192]
                yield np.array(some), np.frombuffer(b"".join(MARK + words[i] for i in some), np.uint8).reshape(len(some), n + len(MARK))

    def log_marginals(self, words: list[bytes], weights: list[tuple[np.ndarray, float]] | None = None) -> np.ndarray:
        """Natural log of each word's marginal probability, a row per weighting (log weights, stop); the lattice is matched once for all."""
        weights = weights or [(self.logp, self.stop)]
        logp, stop = np.stack([w for w, _ in weights]), np.array([s for _, s in weights])
        go = np.log1p(-np.exp(stop))
        scaled, each = self._scaled(logp, go)
        out = np.empty((len(weights), len(words)))
        for ids, rows in self._groups(words):
            if isinstance(rows, bytes):
                out[:, ids] = self._long(rows, logp, go) + stop - go
                continue
            n = rows.shape[1]
            got = self._marginals(self._arcs(rows), n, len(ids), scaled)
            good = ((got > _LEAST) & (got < 1 / _LEAST)).all(0)
            out[:, ids[good]] = np.log(got[:, good]) - (each * n)[:, None] + (stop - go)[:, None]
            for i in ids[~good]:  # out of range: in the log domain
                out[:, i] = self._long(MARK + words[i], logp, go) + stop - go
        return out

    def expected(self, words: list[bytes], weights: list[tuple[np.ndarray, float]], use: np.ndarray, counts: np.ndarray) -> None:
        """Adds to each weighting's row of ``counts`` the expected pieces of the words that its row of ``use`` marks."""
        logp, go = np.stack([w for w, _ in weights]), np.log1p(-np.exp([s for _, s in weights]))
        scaled, _ = self._scaled(logp, go)

        def slowly(word, kinds):
            own = np.zeros((len(kinds), counts.shape[1]))
            self._long(word, logp[kinds], go[kinds], own)
            np.add.at(counts, kinds, own)

        for ids, rows in self._groups(words):
            if isinstance(rows, bytes):
                kinds = np.flatnonzero(use[:, ids])
                if len(kinds):
                    slowly(rows, kinds)
                continue
            at, kind = np.nonzero(use[:, ids].T)  # a row per word and weighting that wants it
            for lo in range(0, len(at), 8192):
                own, mine = rows[at[lo : lo + 8192]], kind[lo : lo + 8192]
                for i in np.flatnonzero(self._expect(self._arcs(own), rows.shape[1], mine, scaled, counts)):
                    slowly(own[i].tobytes(), mine[i : i + 1])


def gathered(batches, rows: int = 100_000):
    """Batches joined to larger ones, which numpy needs for short words."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


# ---------------------------------------------------------------- classes


def fit_classes(docs: list[np.ndarray], k: int, restarts: int = 4, rounds: int = 30, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes (sorted) and their log weights per class (one row per word), from the word hashes of sample texts."""
    flat = np.concatenate(docs) if docs else np.zeros(0, U64)
    keys, n = np.unique(flat, return_counts=True)
    keys = np.sort(keys[np.lexsort((keys, -n))[:CLASS_WORDS]])
    if not len(keys) or k < 2:
        return keys, np.zeros((len(keys), max(1, k)))
    x = np.zeros((len(docs), len(keys)), np.float32)
    for i, d in enumerate(docs):
        at = np.minimum(np.searchsorted(keys, d), len(keys) - 1)
        np.add.at(x[i], at[keys[at] == d], 1)
    rng = np.random.default_rng(seed)
    best = (-np.inf, None)
    share = x.sum(0) / x.sum()
    for _ in range(restarts):
        # seeds far from each other: each next one is drawn where the present classes explain least
        own = x[[rng.integers(len(x))]] + 20 * share
        logw = np.log(own / own.sum() + 1e-12).T
        while logw.shape[1] < k:
            gap = (x * np.log(np.maximum(x / np.maximum(x.sum(1, keepdims=True), 1), 1e-12))).sum(1) - (x @ logw).max(1)
            gap = np.maximum(gap, 0) + 1e-9
            own = x[rng.choice(len(x), p=gap / gap.sum())] + 20 * share
            logw = np.column_stack((logw, np.log(own / own.sum() + 1e-12)))
        pi = np.full(k, 1 / k)
        for _ in range(rounds):
            post = x @ logw + np.log(pi)
            top = post.max(1, keepdims=True)
            like = float((top[:, 0] + np.log(np.exp(post - top).sum(1))).sum())
            post = np.exp(post - top)
            post /= post.sum(1, keepdims=True)
            pi = (post.sum(0) + 1) / (len(x) + k)
            w = post.T @ x + 0.1 * len(keys) * share
            logw = np.log(w / w.sum(1, keepdims=True)).T
        if like > best[0]:
            best = (like, logw)
    return keys, best[1].astype(np.float64)


def buckets(h: np.ndarray) -> np.ndarray:
    return (h >> U64(64 - BUCKET_BITS)).astype(np.int64)


def class_of(h: np.ndarray, words: Words, logw: np.ndarray) -> np.ndarray:
    """The likeliest class of each row by the log weights of its words' buckets (a row per bucket); the first one of rows without words."""
    if logw.shape[1] < 2:
        return np.zeros(len(words.n), np.int64)
    sums = np.zeros((len(words.n) + 1, logw.shape[1]), np.float32)
    filled = np.flatnonzero(words.n)
    if len(filled):
        sums[filled] = np.add.reduceat(logw[buckets(h)], words.first[filled], axis=0)
    return sums[:-1].argmax(1)


def log_weights(counts: np.ndarray) -> np.ndarray:
    """Smoothed log weights, a row per bucket, from counts of classes (rows) and buckets."""
    share = (counts.sum(0) + 0.5) / (counts.sum() + 0.5 * counts.shape[1])
    w = counts + 0.1 * counts.shape[1] * share
    return np.log(w / w.sum(1, keepdims=True)).T.astype(np.float32)


def class_model(train: DataFrame, classes: int, rounds: int = CLASS_ROUNDS) -> np.ndarray:
    """Log weights of word buckets per class, of a fixed size: a start from a sample, then rounds over all texts of ``train`` (doc_id, text)."""
    if classes < 2:
        return np.zeros((1 << BUCKET_BITS, 1))
    short = train.where(F.length("text") <= CLASS_CHARS)
    ids = lowest(short.select("doc_id"), F.col("doc_id"), CLASS_DOCS)
    picked = short.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # CLASS_DOCS rows at most
    words = [Words(*bytes_of(pa.array([r["text"]], pa.string()))) for r in picked]
    hashes = [w.hashes() for w in words]
    keys, logw = fit_classes(hashes, classes)
    counts = np.zeros((classes, 1 << BUCKET_BITS))
    for h in hashes:
        at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
        known = at[keys[at] == h] if len(keys) else at[:0]
        counts[logw[known].sum(0).argmax()] += np.bincount(buckets(h), minlength=counts.shape[1])
    size = 1 << (BUCKET_BITS - 3)  # buckets in a row
    for _ in range(rounds):
        shared = train.sparkSession.sparkContext.broadcast(log_weights(counts))

        def count(batches, shared=shared):
            out = np.zeros((classes, 1 << BUCKET_BITS), np.int64)
            for _, buf, off in slices(batches, "text", 1 << 23):
                words = Words(buf, off)
                h = words.hashes()
                kind = class_of(h, words, shared.value)
                out += np.bincount((kind[words.row()] << BUCKET_BITS) + buckets(h), minlength=out.size).reshape(out.shape)
            rows = out.reshape(-1, size)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array([x.tobytes() for x in rows], pa.binary())], names=["part", "n"])

        def total(batches):
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for k, x in zip(b.column("part").to_pylist(), b.column("n").to_pylist(), strict=True):
                    sums[k] = sums.get(k, 0) + np.frombuffer(x, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "n"])

        made = train.select("text").mapInArrow(count, "part bigint, n binary").repartition("part").mapInArrow(total, "part bigint, n binary").collect()
        if made:  # a few rows of fixed size
            counts = np.concatenate([np.frombuffer(bytes(x["n"]), np.int64) for x in sorted(made, key=lambda x: x["part"])]).reshape(counts.shape).astype(float)
    return log_weights(counts)


# ---------------------------------------------------------------- corpus


def word_counts(docs: DataFrame, model: np.ndarray, classes: int) -> DataFrame:
    """(h, word, c): every distinct word of all texts (A-Z lower-cased), and its counts in the training rows by class.

    Rows with h null carry the numbers of training texts instead.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        ends = np.zeros(classes, np.int64)
        for part, buf, off in slices(batches, "text", 1 << 23):
            words = Words(buf, off)
            every = words.hashes()
            train = part.column("train").to_numpy(zero_copy_only=False).astype(bool)
            kind = class_of(every, words, shared.value)
            ends += np.bincount(kind[train], minlength=classes)
            if not len(words.starts):
                continue
            h, first, inverse = np.unique(every, return_index=True, return_inverse=True)
            row = words.row()
            use = train[row]
            c = np.bincount(inverse[use] * classes + kind[row[use]], minlength=len(h) * classes).reshape(-1, classes)
            low = LOWER[buf].tobytes()
            own = [low[s:e] for s, e in zip(words.starts[first].tolist(), words.ends[first].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(own, pa.binary()).cast(pa.string())] + [pa.array(c[:, k]) for k in range(classes)], names=["h", "word"] + [f"c{k}" for k in range(classes)])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.string())] + [pa.array(ends[k : k + 1]) for k in range(classes)], names=["h", "word"] + [f"c{k}" for k in range(classes)])

    cols = ", ".join(f"c{k} bigint" for k in range(classes))
    found = docs.select("text", "train").mapInArrow(run, f"h bigint, word string, {cols}")
    return found.groupBy("h", "word").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(classes)])


def adapt(first: Lattice, words: DataFrame, classes: int, rounds: int) -> list[Lattice]:
    """Lattices per class after ``rounds`` of expectation over the class's training word types; a row per piece and class returns to the driver."""
    prior = np.exp(first.logp)
    lattices = [first] * classes
    for _ in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast((first.pieces, [(x.logp, x.stop) for x in lattices]))

        def expect(batches, shared=shared):
            pieces, weights = shared.value
            lat = Lattice(pieces, *weights[0])
            counts, types = np.zeros((classes, len(lat.logp))), np.zeros(classes)
            for b in gathered(batches):
                own = [w.encode() for w in b.column("word").to_pylist()]
                use = np.stack([b.column(f"c{k}").to_numpy() > 0 for k in range(classes)])
                types += use.sum(1)
                lat.expected(own, weights, use, counts)
            k, at = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((k, np.arange(classes)))), pa.array(np.concatenate((at, np.full(classes, -1)))), pa.array(np.concatenate((counts[k, at], types)))], names=["k", "piece", "n"])

        counts, types = np.zeros((classes, len(prior))), np.zeros(classes)
        for r in words.mapInArrow(expect, "k bigint, piece bigint, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).collect():
            if r["piece"] < 0:
                types[r["k"]] = r["n"]
            else:
                counts[r["k"], r["piece"]] = r["n"]
        lattices = []
        for k in range(classes):
            total = counts[k].sum()
            lattices.append(Lattice(first.pieces, np.log(PRIOR * prior + counts[k]) - math.log(PRIOR + total), math.log((types[k] + 0.4 * PRIOR) / (total + PRIOR))))
    return lattices


def lattice_scores(
    docs: DataFrame, mod: int = 5, remainder: int = 1, vocabulary: str | None = None, rounds: int = 2, classes: int = CLASSES, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score (log10 probabilities).

    Learns from rows whose crc32 of the id modulo ``mod`` is not ``remainder``; rows
    without an id are held out.  A null or empty text has one token, its end.
    Repeated rows each count and each get a row.  ``lattice_score`` knows the corpus only
    by the share of ends among its tokens.  Without any training text the base
    is uniform and the model is the unadapted lattice.  Other columns play no part.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id, mod, remainder).alias("held_out"), F.col(text).alias("text")).withColumn("train", ~F.col("held_out"))
    model = class_model(src.where("train").select("doc_id", "text"), classes)
    cs = [f"c{k}" for k in range(classes)]
    vocab = written(word_counts(src, model, classes), "words")
    every = sum(F.col(c) for c in cs)
    one = lambda c: [F.sum(c), F.count(F.when(c > 0, 1)), F.count(F.when(c == 1, 1)), F.count(F.when(c == 2, 1))]
    got = vocab.where("h is not null").agg(*[x.alias(f"x{i}") for i, x in enumerate(y for c in [every, *map(F.col, cs)] for y in one(c))]).first()
    stats = np.array([int(x or 0) for x in got], float).reshape(-1, 4)
    docs_k = np.array([int(x or 0) for x in vocab.where("h is null").agg(*[F.sum(c) for c in cs]).first()], float)
    ends = int(docs_k.sum())
    n_all, v = int(stats[0, 0]) + ends, int(stats[0, 1]) + (ends > 0)
    n_k, t_k, n1, n2 = stats[1:].T
    discount = np.where((n1 > 0) & (n2 > 0), np.clip(n1 / np.maximum(n1 + 2 * n2, 1), 0.1, 0.95), 0.75)
    first = Lattice(*read_pieces(vocabulary or default_vocabulary()))
    stop = first.stop
    lattices = adapt(first, vocab.where(F.col("h").isNotNull() & (every > 0)).drop("h"), classes, rounds if v else 0)
    shared = spark.sparkContext.broadcast((first.pieces, [(x.logp, x.stop) for x in lattices], first.logp))
    p_end = (docs_k + 1) / (n_k + docs_k + 2)
    log_pi = np.log((docs_k + 0.5) / (ends + 0.5 * classes))
    ls = [f"l{k}" for k in range(classes)]
    p_stop = (ends + 1) / (n_all + 2)  # a document's end, for the lattice alone

    def score(batches):
        pieces, weights, vocabulary_weights = shared.value
        lat = Lattice(pieces, *weights[0])
        for b in gathered(batches):
            own = [w.encode() for w in b.column("word").to_pylist()]
            cols, total, lows = [], np.zeros(len(own)), lat.log_marginals(own, [*weights, (vocabulary_weights, stop)])
            for k in range(classes):
                c = b.column(f"c{k}").to_numpy().astype(float)
                total += c
                low = lows[k]
                if n_k[k]:
                    with np.errstate(divide="ignore"):
                        low = np.logaddexp(np.log(np.maximum(c - discount[k], 0)), math.log(discount[k] * t_k[k]) + low) - math.log(n_k[k])
                cols.append(pa.array(low + math.log1p(-p_end[k])))
            pure = (lows[classes] + math.log1p(-p_stop)) / math.log(10)
            base = np.log10((total + 0.5) / (n_all + 0.5 * (v + 1)))
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array(total.astype(np.int64)), pa.array(base), pa.array(pure), *cols], names=["h", "c", "base", "pure", *ls])

    scored = written(vocab.where("h is not null").mapInArrow(score, "h bigint, c bigint, base double, pure double, " + ", ".join(f"{x} double" for x in ls)), "scores")
    sums = ["base", "pure", *ls]
    # the least count that leaves at most FREQUENT words, from a histogram of some hundred bars
    bars = scored.where("c > 0").groupBy(F.floor(F.log2("c") * 8).alias("bar")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("bar")).collect()
    least, room = None, FREQUENT
    for r in bars:
        if (room := room - r["n"]) < 0:
            break
        least = r["c"]
    rows = scored.where(F.col("c") >= least).select("h", *sums).collect() if least is not None else []  # at most FREQUENT
    keys = np.array([r["h"] % (1 << 64) for r in rows], U64)
    order = np.argsort(keys)
    frequent = spark.sparkContext.broadcast((keys[order], np.array([r[1:] for r in rows], float).reshape(len(rows), len(sums))[order]))
    del rows
    end = np.concatenate(([math.log10((ends + 0.5) / (n_all + 0.5 * (v + 1))), math.log10(p_stop)], np.log(p_end)))

    def run(batches):
        keys, table = frequent.value
        for part, buf, off in slices(batches, "text"):
            words = Words(buf, off)
            n, h, row = part.num_rows, words.hashes(), words.row()
            if len(keys):
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[at] == h
            else:
                at, hit = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
            here, own = row[hit], table[at[hit]]
            parts = [np.bincount(here, weights=own[:, k], minlength=n) + end[k] for k in range(len(end))]
            known = np.bincount(here, minlength=n)
            r, w = row[~hit], h[~hit]
            order = np.lexsort((w, r))
            r, w = r[order], w[order]
            new = np.ones(len(r), bool)
            new[1:] = (r[1:] != r[:-1]) | (w[1:] != w[:-1])
            start = np.flatnonzero(new)
            k = np.diff(np.append(start, len(r)))
            tail = pa.StructArray.from_arrays([pa.array(w[start].astype(np.int64)), pa.array(k, pa.int64())], names=["h", "k"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(r[start], np.arange(n + 1)), pa.int32()), tail)
            yield pa.RecordBatch.from_arrays(
                [part.column("rid"), part.column("doc_id"), part.column("held_out"), pa.array(words.n + 1, pa.int64()), pa.array(known + int(ends > 0), pa.int64()), *map(pa.array, parts), lists],
                names=["rid", "doc_id", "held_out", "n_tokens", "n_known", *sums, "tail"],
            )

    kind = src.schema["doc_id"].dataType.simpleString()
    schema = f"rid bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, {', '.join(f'{x} double' for x in sums)}, tail array<struct<h:bigint,k:bigint>>"
    part = written(src.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", "text").mapInArrow(run, schema), "partial")
    tail = part.select("rid", F.explode("tail").alias("t")).select("rid", "t.h", "t.k").join(scored, "h")
    rest = tail.groupBy("rid").agg(F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("m_known"), *[F.sum(F.col("k") * F.col(x)).alias(f"m_{x}") for x in sums])
    drop(vocab)
    whole = lambda x: F.col(x) + F.coalesce(f"m_{x}", F.lit(0.0))
    joint = [whole(x) + float(log_pi[k]) for k, x in enumerate(ls)]
    top = F.greatest(*joint) if classes > 1 else joint[0]
    marginal = top + F.log(sum(F.exp(j - top) for j in joint))
    return part.drop("tail").join(rest, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("m_known", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        whole("base").alias("base_score"), (marginal / math.log(10)).alias("score"), whole("pure").alias("lattice_score"),
    )
