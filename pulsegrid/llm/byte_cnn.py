"""Quality by a byte-level convolutional network in numpy.

A text's bytes run through learned filters of ``WIDTH`` bytes at every second
byte.  Two planes feed them: the byte itself, and the smallest distance (up to
``LAGS``) at which the four bytes there stood before, 0 if none.  As both planes
have 256 values, a filter is a table of weights per tap, and the convolution a sum
of look-ups.  Filters are max-pooled over chunks of ``CHUNK`` bytes that overlap by
half and cover the whole text; the chunks' mean and maximum feed one logistic unit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import held_out, labelled_sample
from .scratch import unused
from .textkernel import slices

WIDTH, FILTERS, CHUNK, STRIDE, LAGS = 6, 16, 512, 2, 32
HALF = CHUNK // 2
TAPS = [(0, j) for j in range(WIDTH)] + [(1, 0), (1, 4)]  # plane and offset


def lag_plane(b: np.ndarray) -> np.ndarray:
    """For each byte, the smallest distance at which the same four bytes stood before, else 0."""
    out = np.zeros(len(b), np.uint8)
    if len(b) < 5:
        return out
    quad = b[:-3].astype(np.uint32) | b[1:-2].astype(np.uint32) << 8 | b[2:-1].astype(np.uint32) << 16 | b[3:].astype(np.uint32) << 24
    for lag in range(min(LAGS, len(quad) - 1), 0, -1):
        np.putmask(out[lag : len(quad)], quad[lag:] == quad[:-lag], lag)
    return out


@dataclass
class Network:
    tables: np.ndarray  # taps x 256 x filters
    bias: np.ndarray
    out: np.ndarray  # 2 * filters weights and a bias

    def halves(self, b: np.ndarray, want_argmax: bool = False):
        """Max-pooled filters of each half chunk of one text (padded with zero bytes)."""
        n = max(1, -(-len(b) // HALF))
        planes = np.zeros((2, n * HALF + WIDTH), np.uint8)
        planes[0, : len(b)] = b
        planes[1, : len(b)] = lag_plane(b)
        at = n * HALF
        act = np.repeat(self.bias[None, :], at // STRIDE, 0)
        for t, (plane, j) in enumerate(TAPS):
            act += self.tables[t][planes[plane, j : at + j : STRIDE]]
        act = act.reshape(n, HALF // STRIDE, FILTERS)
        if want_argmax:
            top = act.argmax(1)
            return np.take_along_axis(act, top[:, None, :], 1)[:, 0], top, planes
        return act.max(1)

    def document(self, halves: np.ndarray) -> np.ndarray:
        """Features of a text from its half chunks: mean and maximum over its overlapping chunks."""
        chunks = np.maximum(np.maximum(halves[:-1], halves[1:]) if len(halves) > 1 else halves, 0)
        return np.concatenate((chunks.mean(0), chunks.max(0)))

    def probability(self, b: np.ndarray) -> float:
        z = self.document(self.halves(b)) @ self.out[:-1] + self.out[-1]
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def train(sample: list[tuple[str, int]], epochs: int = 8, rate: float = 0.02, seed: int = 3, window: int = 8 * HALF) -> Network:
    """Adam over labelled texts; each visit to a long text sees a random stretch of ``window`` bytes. Both labels weigh the same."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.25, (len(TAPS), 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), np.concatenate((rng.normal(0, 0.1, 2 * FILTERS), [0])).astype(np.float32))
    ys = [y for _, y in sample]
    if len(set(ys)) < 2:
        net.out[:] = 0
        net.out[-1] = 2.0 if 1 in ys else (-2.0 if ys else 0.0)
        return net
    data = [(np.frombuffer(t.encode(), np.uint8), y) for t, y in sample]
    weight = {y: len(ys) / (2 * ys.count(y)) for y in (0, 1)}
    params = [net.tables, net.bias, net.out]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        for lo in range(0, len(order), 32):
            grads = [np.zeros_like(p) for p in params]
            for i in order[lo : lo + 32]:
                b, y = data[i]
                if len(b) > window:
                    s = int(rng.integers(0, len(b) - window + 1))
                    b = b[s : s + window]
                h, top, planes = net.halves(b, True)
                x = net.document(h)
                p = 1 / (1 + np.exp(-np.clip(x @ net.out[:-1] + net.out[-1], -40, 40)))
                d = weight[y] * (p - y) / 32
                grads[2][:-1] += d * x
                grads[2][-1] += d
                dx = d * net.out[:-1]
                # back through mean and maximum over chunks, the pair of halves, and the pooled position
                if len(h) > 1:
                    left = h[:-1] >= h[1:]
                    chunk = np.maximum(h[:-1], h[1:])
                    src = np.where(left, np.arange(len(h) - 1)[:, None], np.arange(1, len(h))[:, None])
                else:
                    chunk, src = h, np.zeros((1, FILTERS), np.int64)
                g = np.repeat(dx[None, :FILTERS] / len(chunk), len(chunk), 0)
                g[chunk.argmax(0), np.arange(FILTERS)] += dx[FILTERS:]
                g *= chunk > 0
                f = np.broadcast_to(np.arange(FILTERS), src.shape)
                pos = (src * HALF + top[src, f] * STRIDE).ravel()
                f, g = f.ravel(), g.ravel()
                grads[1] += np.bincount(f, weights=g, minlength=FILTERS).astype(np.float32)
                for t, (plane, j) in enumerate(TAPS):
                    grads[0][t].reshape(-1)[:] += np.bincount(planes[plane, pos + j].astype(np.int64) * FILTERS + f, weights=g, minlength=256 * FILTERS).astype(np.float32)
            step += 1
            lr = rate * (1 - epoch / (epochs + 1))
            for k, (p, g) in enumerate(zip(params, grads, strict=True)):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                p -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    return net


def score(docs: DataFrame, net: Network, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default, but the text) and ``score``: the probability of good quality. A null or empty text is one chunk of zero bytes."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (text, "score")]
    whole = unused("text", keep)
    src = docs.select(*keep, F.col(text).alias(whole))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        own = shared.value
        for part, buf, off in slices(batches, whole):
            p = np.array([probability(own, buf[off[i] : off[i + 1]]) for i in range(part.num_rows)])
            yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(p, pa.float64())], names=[*keep, "score"])

    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != whole] + ["score double"])
    return src.mapInArrow(run, fields)


def probability(net: Network, b: np.ndarray, stretch: int = 1024 * HALF) -> float:
    """As ``net.probability``; a very long text is convolved stretch by stretch, with the bytes that reach over its borders."""
    if len(b) <= stretch:
        return net.probability(b)
    parts = []
    for s in range(0, len(b), stretch):
        before = min(s, HALF)  # distances and filters see the neighbouring bytes
        h = net.halves(b[s - before : s + stretch + HALF])
        parts.append(h[before // HALF :][: -(-min(stretch, len(b) - s) // HALF)])
    z = net.document(np.concatenate(parts)) @ net.out[:-1] + net.out[-1]
    return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(docs: DataFrame, labels: DataFrame, mod: int = 3, remainder: int = 1, per_class: int = 1200, max_chars: int = 20_000) -> Network:
    """A network from at most ``per_class`` texts of each label of rows that are not held out."""
    return train(labelled_sample(docs, labels, "quality", mod, remainder, per_class, max_chars))


def quality(docs: DataFrame, labels: DataFrame, mod: int = 3, remainder: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; learns from rows that are not held out.

    Null and empty texts are scored as one chunk of zero bytes; rows without an id are held
    out; equal texts get equal scores; repeated rows each get a row.  Without labels, or with
    one alone, the score is constant (0.5, or what that label is).  Other columns play no part.
    """
    out = score(docs.select("doc_id", "text"), fit(docs, labels, mod, remainder))
    return out.select("doc_id", held_out("doc_id", mod, remainder).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


