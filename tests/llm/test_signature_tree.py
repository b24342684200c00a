import random
import re

import numpy as np
import pytest
from pulsegrid.llm import signature_tree as S
from pulsegrid.llm.graph import components
from pyspark.sql import functions as F


def brute(rows, size, num, den):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x and y and den * len(x & y) >= num * len(x | y):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted([(d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)], key=str)


def corpus(seed, n=140):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    base = [[r.choice(vocab) for _ in range(r.choice([3, 4, 8, 40, 90, 300]))] for _ in range(14)]
    shared = [r.choice(vocab) for _ in range(55)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
            w[r.randrange(len(w))] = r.choice(vocab)
        if r.random() < 0.3:
            w = w + shared
        rows.append((i, " ".join(x.upper() if r.random() < 0.05 else x for x in w)))
    return rows + [(500, None), (501, ""), (502, " \n"), (None, rows[3][1]), (7, rows[7][1]), (503, "one"), (504, "ONE")]


@pytest.mark.parametrize(("size", "num", "den"), [(4, 85, 100), (5, 4, 5)])
def test_components_equal_brute_force(spark, size, num, den):
    rows = corpus(size)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, component_id string, n long")
    got = [tuple(r) for r in S.jaccard_components(df, size, num, den).collect()]
    assert sorted(got, key=str) == brute(rows, size, num, den)


def test_empty_table(spark):
    assert S.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tree_loses_no_pair():
    r = np.random.default_rng(1)
    base = [r.integers(0, 2**63, 400).astype(np.uint64) for _ in range(5)]
    sets = []
    for _ in range(150):
        b = base[r.integers(5)][: r.integers(20, 400)]
        sets.append(np.unique(np.concatenate((b[r.random(len(b)) > r.choice([0.0, 0.05, 0.2])], r.integers(0, 2**63, r.integers(0, 20)).astype(np.uint64)))))
    sets.sort(key=len)
    n = np.array([len(s) for s in sets])
    sigs = [np.frombuffer(S.signature(s), np.uint64) for s in sets]
    found = set()
    for i, j, _ in S.candidates(n, n * 100 // 85, sigs, np.arange(len(n)), np.ones(len(n), bool), 85, 100):
        found |= set(zip(i.tolist(), j.tolist(), strict=True))
    want = {(i, j) for i in range(len(n)) for j in range(i + 1, len(n)) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    assert want <= found and len(found) < len(n) * (len(n) - 1) // 4


def test_caps_admit_every_link_at_its_first_shared_shingle():
    r = np.random.default_rng(2)
    linked = 0
    for num, den in [(85, 100), (4, 5)]:
        for _ in range(400):
            x = np.sort(r.choice(200, r.integers(1, 60), replace=False))
            y = np.unique(np.concatenate((x[r.random(len(x)) > 0.07], r.choice(200, r.integers(0, 4)))))
            both = np.intersect1d(x, y)
            if len(y) and den * len(both) >= num * len(np.union1d(x, y)):
                linked += 1
                for own, other in ((x, y), (y, x)):
                    rank = int(np.searchsorted(own, both[0]))
                    assert rank <= len(own) - S.need(len(own), num, den)
                    assert len(other) <= S.cap(len(own), rank, num, den)
    assert linked > 100


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 8)
    monkeypatch.setattr(S, "FIRST", 1)
    rows = corpus(9, 90)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted([tuple(r) for r in S.jaccard_components(df, 4, 85, 100).collect()], key=str) == brute(rows, 4, 85, 100)


def test_components_of_a_long_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    assert {tuple(r) for r in components(path).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def test_one_per_component(spark):
    rows = corpus(5)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, tk string")
    kept = S.one_per_component(df)
    want = {}
    for (d, _, c), (_, t) in zip(sorted(brute(rows, 5, 4, 5), key=str), sorted(rows, key=lambda r: str(r[0])), strict=True):
        want.setdefault(c if d is not None else None, t)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == df.columns and len(ids) == len(set(ids))
    assert set(ids) == {c for _, n, c in brute(rows, 5, 4, 5) if n} | {500, 501, 502}


@pytest.mark.parametrize("hot", [0, 4, 99])
def test_prefix_groups_and_blocks_lose_no_link(spark, monkeypatch, hot):
    """Without the stars' links all must come from the groups, cut by sizes or not, dealt in small blocks, by shuffled joins."""
    for name, value in (("HOT", hot), ("BLOCK", 4), ("LEAF", 2), ("FIRST", 1), ("BROADCAST_ROWS", 0), ("BROADCAST_IDS", 0)):
        monkeypatch.setattr(S, name, value)
    monkeypatch.setattr(S, "_stars", lambda nodes, num, den: nodes.sparkSession.createDataFrame([], "a long, b long"))
    rows = corpus(20 + hot, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted([tuple(r) for r in S.jaccard_components(df, 4, 85, 100).collect()], key=str) == brute(rows, 4, 85, 100)


def test_the_same_row_stays_in_every_run(spark):
    text = "one two three four five six seven"
    rows = [(1, text, i, {"k": i}, "t") for i in range(30)] + [(2, text, 99, None, "t"), (None, "x y", 5, None, "t"), (None, "x y", 6, None, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, m map<string,int>, FIRST string")
    kept = [sorted(map(str, S.one_per_component(d).collect())) for d in (df, df.repartition(5), df.orderBy(F.desc("n")))]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 2
