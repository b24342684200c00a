"""Generating signals for contexts with broadcast weights."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pulsegrid.gan.model import U64, Net, mix, noises
from pulsegrid.operators import train
from pulsegrid.operators.motifs import Motif


STEP = 1024  # rows whose layers stay in a processor's cache


def signals(net: Net, keys: np.ndarray, kmers: np.ndarray, meths: np.ndarray, seed: int = 0) -> np.ndarray:
    """Raw signals (0..255, two columns); the noise of a row follows from its key."""
    weights, out = net.ready(), np.empty((len(keys), 2), np.float32)
    for i in range(0, len(keys), STEP):
        at = slice(i, i + STEP)
        out[at] = net.infer(noises(keys[at], net.noise, seed), kmers[at], meths[at], weights)
    return np.clip(np.expm1(out), 0, 255)


def _kernel(shared, own: list[str], seed: int, batch: int):
    """Batches with kmer, meth_id and ``own`` to batches that also have ipd and pw, ``batch`` rows each; ``own`` gives the keys."""

    def run(batches):
        g = shared.value
        for whole in batches:
            for i in range(0, whole.num_rows, batch):
                b = whole.slice(i, batch)
                kmer = b.column("kmer").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                meth = b.column("meth_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                keys = np.zeros(b.num_rows, U64)
                for c in own:
                    col = b.column(c)
                    part = np.array([hash_text(str(x)) for x in col.to_pylist()], U64) if not pa.types.is_integer(col.type) else col.fill_null(0).to_numpy(zero_copy_only=False).astype(U64)
                    keys = mix(keys + part)
                s = signals(g, keys, np.maximum(kmer, 0), meth, seed).astype(np.int32)
                s[kmer < 0] = 1
                yield pa.RecordBatch.from_arrays(b.columns + [pa.array(s[:, 0]), pa.array(s[:, 1])], names=b.schema.names + ["ipd", "pw"])

    return run


def generate(contexts: DataFrame, net: Net, seed: int = 0, batch: int = 16_384) -> DataFrame:
    """Adds ``ipd`` and ``pw`` (0..255, truncated) to rows with kmer and meth_id; a null kmer (default window) gets 1."""
    shared = contexts.sparkSession.sparkContext.broadcast(net)
    own = [c for c in contexts.columns if c not in ("kmer", "meth_id", "ipd", "pw")]
    contexts = contexts.select(*[c for c in contexts.columns if c not in ("ipd", "pw")])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in contexts.schema)
    return contexts.mapInArrow(_kernel(shared, own, seed, batch), fields + ", ipd int, pw int")


def generate_samples(reads: DataFrame | train.Packed, motifs: list[Motif], keep: list[str], net: Net, seed: int = 0, batch: int = 16_384) -> DataFrame:
    """``generate`` of the windows of reads, whose rows go to Spark but once, with their signals."""
    frame = reads.frame if isinstance(reads, train.Packed) else reads
    run = _kernel(frame.sparkSession.sparkContext.broadcast(net), [*keep, "pos"], seed, batch)
    return train.samples(reads, motifs, keep, then=lambda batches: run(b.select([*keep, "pos", "kmer", "meth_id"]) for b in batches), signal="int")


def hash_text(s: str) -> int:
    import zlib

    b = s.encode()
    return zlib.crc32(b) << 32 | zlib.adler32(b)
