"""Conditional generator and critic in numpy, with their backward passes.

Both see a k-mer embedding and a methylation embedding.  Rows of k-mers that were
never trained follow from a hash of the k-mer, distributed as fresh rows would be,
so only observed k-mers take memory.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

import numpy as np

METHS, METH_DIM = 4, 8
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = x + U64(0x9E3779B97F4A7C15)
    t = x >> U64(30)
    for factor, shift in ((0xBF58476D1CE4E5B9, 27), (0x94D049BB133111EB, 31)):  # in place: arrays that stay in a processor's cache
        x ^= t
        x *= U64(factor)
        t = np.right_shift(x, U64(shift), out=t) if x.ndim else x >> U64(shift)
    return x ^ t


def noises(keys: np.ndarray, n: int, seed: int) -> np.ndarray:
    """n normal numbers (single precision) for each key that depend on key and seed alone; a pair of uniform ones gives two."""
    base = mix(keys.astype(U64) ^ mix(np.array([seed], U64)))[:, None] + np.arange((n + 1) // 2, dtype=U64)[None, :]
    x = mix(base)
    r = (x >> U64(40)).astype(np.uint32).astype(np.float32)
    r += np.float32(0.5)
    r *= np.float32(2**-24)
    np.log(r, out=r)
    r *= np.float32(-2)
    np.sqrt(r, out=r)
    turn = (x.astype(np.uint32) & np.uint32(0xFFFFFF)).astype(np.float32)
    turn *= np.float32(2 * np.pi * 2**-24)
    half = r.shape[1]
    out = np.empty((len(r), 2 * half), np.float32)
    np.multiply(r, np.cos(turn), out=out[:, :half])
    np.multiply(r, np.sin(turn, out=turn), out=out[:, half:])
    return out[:, :n]


class Embedding:
    """Rows of observed k-mers; all others by hash."""

    def __init__(self, dim: int, seed: int, ids: np.ndarray | None = None):
        self.dim, self.seed = dim, seed
        self.ids = np.zeros(0, np.int64) if ids is None else np.unique(ids).astype(np.int64)
        self.rows = 0.02 * noises(self.ids, dim, seed).astype(float)

    def index(self, kmers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.ids):
            return np.zeros(len(kmers), np.int64), np.zeros(len(kmers), bool)
        at = np.minimum(np.searchsorted(self.ids, kmers), len(self.ids) - 1)
        return at, self.ids[at] == kmers

    def __call__(self, kmers: np.ndarray) -> np.ndarray:
        at, known = self.index(kmers)
        out = np.empty((len(kmers), self.dim))
        if known.any():
            out[known] = self.rows[at[known]]
        if (~known).any():
            own, inverse = np.unique(kmers[~known], return_inverse=True)
            out[~known] = (0.02 * noises(own, self.dim, self.seed))[inverse]
        return out

    def single(self, kmers: np.ndarray) -> np.ndarray:
        """The same rows in single precision, made anew for each unseen k-mer of ``kmers``."""
        at, known = self.index(kmers)
        if known.all() and len(kmers):
            return self.rows.take(at, 0).astype(np.float32)
        out = noises(kmers, self.dim, self.seed)
        out *= np.float32(0.02)
        if known.any():
            out[known] = self.rows[at[known]]
        return out


@dataclass
class Net:
    """Linear - [LayerNorm] - LeakyReLU - [dropout], twice, then linear."""

    kind: str
    noise: int
    embed: Embedding
    hidden: int = 128
    dropout: float = 0.0
    p: dict = field(default_factory=dict)

    @property
    def norm(self) -> bool:
        return True

    def init(self, seed: int) -> Net:
        r = np.random.default_rng(seed)
        first = self.noise if self.kind == "generator" else 2
        sizes = [first + self.embed.dim + METH_DIM, self.hidden, self.hidden, 2 if self.kind == "generator" else 1]
        for k in range(3):
            a = np.sqrt(6 / (sizes[k] + sizes[k + 1]))
            self.p[f"w{k}"], self.p[f"b{k}"] = r.uniform(-a, a, (sizes[k], sizes[k + 1])), np.zeros(sizes[k + 1])
            if k < 2:
                self.p[f"g{k}"], self.p[f"h{k}"] = np.ones(self.hidden), np.zeros(self.hidden)
        self.p["meth"] = 0.02 * r.normal(size=(METHS, METH_DIM))
        return self

    def forward(self, x: np.ndarray, kmers: np.ndarray, meths: np.ndarray, masks=None):
        """Output and what backward needs; ``masks`` are dropout masks of both hidden layers."""
        h = np.concatenate((x, self.embed(kmers), self.p["meth"][meths]), 1)
        tape = []
        for k in range(2):
            z = h @ self.p[f"w{k}"] + self.p[f"b{k}"]
            mu, sd = z.mean(1, keepdims=True), np.sqrt(z.var(1, keepdims=True) + 1e-5)
            norm = (z - mu) / sd
            y = norm * self.p[f"g{k}"] + self.p[f"h{k}"]
            act = np.where(y > 0, y, 0.2 * y)
            if masks is not None:
                act = act * masks[k]
            tape.append((h, norm, sd, y))
            h = act
        return h @ self.p["w2"] + self.p["b2"], (tape, h, kmers, meths, masks)

    def ready(self) -> dict[str, np.ndarray]:
        """Weights for ``infer`` in single precision. What a layer adds to all its outputs alike, its norm takes away: it is taken from the weights."""
        n = len(self.p["w0"]) - METH_DIM
        flat = lambda x: x - x.mean(1, keepdims=True)
        w = {"w0": flat(self.p["w0"][:n]), "meth": flat(self.p["meth"] @ self.p["w0"][n:] + self.p["b0"]), "w1": flat(self.p["w1"]), "b1": flat(self.p["b1"][None])[0]}
        return {k: v.astype(np.float32) for k, v in (self.p | w).items()}

    def infer(self, x: np.ndarray, kmers: np.ndarray, meths: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
        """The output without dropout, in single precision, of the weights of ``ready``.

        A norm divides each row by one number, which the steps behind it that add nothing
        let through: it is multiplied in where something is added, or at the end.
        """
        n, eps = len(w["w0"]) - self.embed.dim, np.float32(1e-5)
        z = self.embed.single(kmers) @ w["w0"][n:]
        z += x @ w["w0"][:n]
        z += w["meth"].take(meths, 0)
        t, scale = np.empty_like(z), np.ones((len(z), 1), np.float32)
        for k in range(2):
            square = np.einsum("ij,ij->i", z, z)[:, None] / np.float32(z.shape[1])
            scale = scale / np.sqrt(square * scale * scale + eps)
            if (w[f"g{k}"] != 1).any():
                z *= w[f"g{k}"]
            if w[f"h{k}"].any():
                z, scale = z * scale + w[f"h{k}"], np.ones_like(scale)
            np.multiply(z, np.float32(0.2), out=t)
            np.maximum(z, t, out=z)
            if k == 0:
                z, t = np.matmul(z, w["w1"], out=t), z
                if w["b1"].any():
                    z, scale = z * scale + w["b1"], np.ones_like(scale)
        return (z @ w["w2"]) * scale + w["b2"]

    def backward(self, grad: np.ndarray, saved) -> tuple[np.ndarray, dict]:
        """Gradient to the first input and to all parameters (``kmer``: rows of the embedding)."""
        tape, last, kmers, meths, masks = saved
        g = {"w2": last.T @ grad, "b2": grad.sum(0)}
        d = grad @ self.p["w2"].T
        for k in (1, 0):
            h, norm, sd, y = tape[k]
            if masks is not None:
                d = d * masks[k]
            d = d * np.where(y > 0, 1.0, 0.2)
            g[f"g{k}"], g[f"h{k}"] = (d * norm).sum(0), d.sum(0)
            d = d * self.p[f"g{k}"]
            d = (d - d.mean(1, keepdims=True) - norm * (d * norm).mean(1, keepdims=True)) / sd
            g[f"w{k}"], g[f"b{k}"] = h.T @ d, d.sum(0)
            d = d @ self.p[f"w{k}"].T
        n = d.shape[1] - self.embed.dim - METH_DIM
        g["meth"] = np.zeros_like(self.p["meth"])
        np.add.at(g["meth"], meths, d[:, n + self.embed.dim :])
        g["kmer"] = np.zeros_like(self.embed.rows)
        at, known = self.embed.index(kmers)
        np.add.at(g["kmer"], at[known], d[known, n : n + self.embed.dim])
        return d[:, :n], g

    def parameters(self) -> dict[str, np.ndarray]:
        return self.p | {"kmer": self.embed.rows}

    def masks(self, n: int, rng: np.random.Generator):
        if not self.dropout:
            return None
        return [(rng.random((n, self.hidden)) >= self.dropout) / (1 - self.dropout) for _ in range(2)]


def new_generator(noise: int = 32, embed: int = 64, hidden: int = 128, ids: np.ndarray | None = None, seed: int = 0) -> Net:
    return Net("generator", noise, Embedding(embed, seed, ids), hidden).init(seed)


def new_critic(embed: int = 64, hidden: int = 128, dropout: float = 0.3, ids: np.ndarray | None = None, seed: int = 1) -> Net:
    return Net("critic", 0, Embedding(embed, seed, ids), hidden, dropout).init(seed)


def save(path: str, generator: Net, critic: Net, extra: dict, arrays: dict) -> None:
    """A checkpoint: weights and optimiser state, and the settings beside it as JSON."""
    out = dict(arrays)
    for name, net in (("G", generator), ("D", critic)):
        out |= {f"{name}.{k}": v for k, v in net.parameters().items()} | {f"{name}.ids": net.embed.ids}
    np.savez(path, **out)
    settings = {"noise_dim": generator.noise, "kmer_embed_dim": generator.embed.dim, "hidden_dim": generator.hidden, "seed_g": generator.embed.seed, "seed_d": critic.embed.seed} | extra
    with open(os.path.join(os.path.dirname(path) or ".", "model_config.json"), "w") as f:
        json.dump(settings, f, indent=1)


def load(path: str) -> tuple[Net, Net, dict, dict]:
    """Generator, critic, settings and all arrays of a checkpoint; settings that are missing get their defaults."""
    at = os.path.join(os.path.dirname(path) or ".", "model_config.json")
    settings = json.load(open(at)) if os.path.exists(at) else {}
    arrays = dict(np.load(path))
    ids = arrays.get("G.ids")
    g = new_generator(settings.get("noise_dim", 32), settings.get("kmer_embed_dim", 64), settings.get("hidden_dim", 128), ids, settings.get("seed_g", 0))
    d = new_critic(settings.get("kmer_embed_dim", 64), settings.get("hidden_dim", 128), ids=ids, seed=settings.get("seed_d", 1))
    for name, net in (("G", g), ("D", d)):
        for k in net.p:
            net.p[k] = arrays[f"{name}.{k}"]
        net.embed.rows = arrays[f"{name}.kmer"]
    return g, d, settings, arrays
