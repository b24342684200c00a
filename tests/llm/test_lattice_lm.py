import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pulsegrid.llm import lattice_lm as M
from pyspark.sql import functions as F

PIECES = [b"\xe2\x96\x81", b"\xe2\x96\x81a", b"a", b"b", b"ab", b"ba", b"aba", b"\xc3\xa9"]


def toy():
    logp = np.log(np.random.default_rng(0).dirichlet(np.ones(len(PIECES) + 256)))
    return M.Lattice(PIECES, logp, math.log(0.3))


def brute(lat, word, seen=None):
    """Sum over all segmentations, and expected counts."""
    s, go, total, counts = M.MARK + word, math.log(0.7), 0.0, Counter()

    def walk(i, path, lp):
        nonlocal total
        if i == len(s):
            p = math.exp(lp + lat.stop - go)
            total += p
            for k in path:
                counts[k] += p
            return
        for k, x in enumerate(lat.pieces):
            if s.startswith(x, i):
                walk(i + len(x), [*path, k], lp + lat.logp[k] + go)
        k = len(lat.pieces) + s[i]
        walk(i + 1, [*path, k], lp + lat.logp[k] + go)

    walk(0, [], 0.0)
    return math.log(total), {k: v / total for k, v in counts.items()}


@pytest.mark.parametrize("long", [M.LONG, 0])
def test_marginal_and_expectation_equal_enumeration(monkeypatch, long):
    monkeypatch.setattr(M, "LONG", long)
    lat = toy()
    words = [b"a", b"ab", b"abab", b"b\xc3\xa9a", b"xx", b"aba"]
    other = (np.roll(lat.logp, 3), math.log(0.3))
    counts = np.zeros((2, len(lat.logp)))
    both = lat.log_marginals(words, [(lat.logp, lat.stop), other])
    got = both[0]
    lat.expected(words, [(lat.logp, lat.stop), other], np.stack((np.ones(len(words), bool), np.arange(len(words)) % 2 == 0)), counts)
    second = M.Lattice(PIECES, *other)
    for w, g in zip(words, both[1], strict=True):
        assert g == pytest.approx(brute(second, w)[0])
    half = Counter()
    for w in words[::2]:
        half.update(brute(second, w)[1])
    assert all(counts[1, k] == pytest.approx(half.get(k, 0.0), abs=1e-12) for k in range(counts.shape[1]))
    counts = counts[0]
    want = Counter()
    for w, g in zip(words, got, strict=True):
        lp, c = brute(lat, w)
        assert g == pytest.approx(lp)
        want.update(c)
    for k in range(len(counts)):
        assert counts[k] == pytest.approx(want.get(k, 0.0), abs=1e-12)


def test_scores_and_base(spark, docs_small, monkeypatch):
    rows = [(d, t, "clash") for d, t, *_ in docs_small] + [(100 + i, f"some new words{i} and the fox jumps é{i % 3}", "c") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = M.lattice_scores(df).collect()
    assert len(got) == len(rows)
    held = lambda d: d is None or zlib.crc32(str(d).encode()) % 5 == 1
    toks = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    c = Counter(x for d, t, _ in rows if not held(d) for x in toks(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), held(d), len(toks(t)), sum(c[x] > 0 for x in toks(t)), round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in toks(t)), 6)) for d, t, _ in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n}
    assert all(r.score < 0 for r in got)
    # the same results when no word is in the broadcast table
    monkeypatch.setattr(M, "FREQUENT", 3)
    again = M.lattice_scores(df).collect()
    key = lambda r: (str(r.doc_id), r.n_tokens, round(r.score, 8), round(r.base_score, 8), r.n_known)
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert M.lattice_scores(df.limit(0)).count() == 0


@pytest.mark.parametrize("stretch", [1, 7, 64])
def test_long_words_in_stretches(monkeypatch, stretch):
    lat, r = toy(), np.random.default_rng(2)
    words = [bytes(r.choice(np.frombuffer(b"abxa", np.uint8), n)) for n in (1, 20, 63, 64, 65, 200)]
    weights = [(lat.logp, lat.stop), (np.roll(lat.logp, 3), math.log(0.2))]
    use = np.array([[True] * 6, [False, True] * 3])
    want, counts = lat.log_marginals(words, weights), np.zeros((2, len(lat.logp)))
    lat.expected(words, weights, use, counts)
    monkeypatch.setattr(M, "LONG", 0)
    monkeypatch.setattr(M, "STRETCH", stretch)
    again = np.zeros_like(counts)
    lat.expected(words, weights, use, again)
    assert lat.log_marginals(words, weights) == pytest.approx(want) and again == pytest.approx(counts, abs=1e-9)


def test_a_word_of_a_megabyte():
    lat = toy()
    got = lat.log_marginals([b"ab" * 250_000])[0, 0]
    assert got == pytest.approx(lat.log_marginals([b"ab" * 5_000])[0, 0] * 50, rel=0.01)


def test_scores_equal_a_plain_version(spark):
    rows = [(i, " ".join(f"w{j * j % (i % 7 + 3)}" for j in range(i % 11))) for i in range(60)] + [(60, None), (61, "Once  upon\na TIME"), (61, "Once  upon\na TIME"), (None, "w1 zebra")]
    got = M.lattice_scores(spark.createDataFrame(rows, "doc_id long, text string"), classes=1, rounds=0).collect()
    held = lambda d: d is None or zlib.crc32(str(d).encode()) % 5 == 1
    toks = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    c = Counter(x for d, t in rows if not held(d) for x in toks(t))
    ends, n, types = sum(not held(d) for d, _ in rows), sum(c.values()), len(c)
    n1, n2 = (sum(v == k for v in c.values()) for k in (1, 2))
    discount = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 and n2 else 0.75
    lat = M.Lattice(*M.read_pieces(M.default_vocabulary()))
    low = lambda w: math.exp(lat.log_marginals([w.encode()])[0, 0])
    end, stop = (ends + 1) / (n + ends + 2), (ends + 1) / (n + ends + 2)

    def score(t):
        return math.log10(end) + sum(math.log10((1 - end) * (max(c[w] - discount, 0) + discount * types * low(w)) / n) for w in toks(t))

    pure = lambda t: math.log10(stop) + sum(math.log10((1 - stop) * low(w)) for w in toks(t))
    want = sorted((str(d), round(score(t), 6), round(pure(t), 6)) for d, t in rows)
    assert sorted((str(x.doc_id), round(x.score, 6), round(x.lattice_score, 6)) for x in got) == want


def test_classes_follow_from_all_texts(spark, monkeypatch):
    monkeypatch.setattr(M, "CLASS_DOCS", 20)
    tongues = ["the of and to in is".split(), "der die und in den von".split(), "rare kinds of words stand here only".split()]
    rows = [(i, " ".join(tongues[2 if i % 100 == 99 else i % 2][(j * 7 + i) % 6] for j in range(40))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a = M.class_model(df, 3)
    assert np.array_equal(a, M.class_model(df.repartition(7), 3))  # no order matters
    kind = M.class_of(*(lambda w: (w.hashes(), w))(M.Words(*M.bytes_of(M.pa.array([t for _, t in rows])))), a)
    assert len({k for k, (i, _) in zip(kind, rows, strict=True) if i % 100 != 99 and i % 2 == 0}) == 1
    assert set(kind[0::2]).isdisjoint(kind[[i for i in range(1, 600, 2) if i % 100 != 99]])
    same = df.withColumn("doc_id", F.lit(5).cast("long"))  # one id for all rows
    assert M.class_model(same, 3).shape == (1 << M.BUCKET_BITS, 3) and M.class_model(df.limit(0), 3).shape[1] == 3


def test_adapted_weights_suit_held_out_texts_better(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    total = [sum(x.score for x in M.lattice_scores(df, rounds=r).collect() if x.held_out) for r in (0, 2)]
    assert total[1] > 0.9 * total[0] and total[1] > total[0]


def test_sums_out_of_range_are_solved_in_logs(monkeypatch):
    lat = toy()
    words = [b"abab", b"xxxxxxx", b"aba"]
    weights, use = [(lat.logp, lat.stop), (np.roll(lat.logp, 5), lat.stop)], np.ones((2, 3), bool)
    want, counts = lat.log_marginals(words, weights), np.zeros((2, len(lat.logp)))
    lat.expected(words, weights, use, counts)
    monkeypatch.setattr(M, "_LEAST", 2.0)  # nothing is in range
    again = np.zeros_like(counts)
    lat.expected(words, weights, use, again)
    assert lat.log_marginals(words, weights) == pytest.approx(want) and again == pytest.approx(counts, abs=1e-12)
    steep = np.full(len(lat.logp), -60.0)  # far below what the scale can hold
    steep[0] = -1e-9
    assert M.Lattice(PIECES, steep).log_marginals([b"q" * 40])[0, 0] == pytest.approx(-60 * 40 + 41 * math.log(0.6) + math.log(0.4 / 0.6) - 1e-9, rel=1e-6)
