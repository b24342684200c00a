import heapq
import random
import re
from fractions import Fraction

import duckdb
from pulsegrid import shared
from pulsegrid.llm import mixing as M
from pyspark.sql import functions as F


def level(sizes):
    """Targets by resharing, one round after the other."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = Fraction(total - sum(3 * sizes[s] for s in capped))
        t = {s: Fraction(3 * sizes[s]) if s in capped else rest * w[s] / sum(w[x] for x in sizes if x not in capped) for s in sizes}
        over = {s for s in sizes if s not in capped and t[s] > 3 * sizes[s]}
        if not over:
            return t
        capped |= over


def webster(weights, seats, most):
    got = dict.fromkeys(weights, 0)
    for _ in range(seats):
        s = max((s for s in weights if got[s] < most[s] and weights[s] > 0), key=lambda s: (Fraction(weights[s]) / (2 * got[s] + 1), weights[s]))
        got[s] += 1
    return got


def corpus(seed, n=900):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        s = r.choice(["hot"] * 5 + ["a", "b", "c", "é", "Z", None])
        k = r.choice([0, 1, 3, 20, 50, 200]) if s not in ("b", "Z") else r.choice([0, 1, 2])
        rows.append((i if i % 50 else None, " ".join(["w"] * k) if k or i % 2 else None, s, 1.0))
    return rows + rows[:3]


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(M, "SHARD_DOCS", 100)
    rows = corpus(4)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target double")
    got = M.mix(df).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source]
    want = level(sizes)
    for r in got:
        assert abs(r.target - float(want[r.source])) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 32 + 0.01 * want[s]
    again = M.mix(df.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r.size, str(r.source), r.taken)
    assert sorted(map(key, again)) == sorted(map(key, got))
    other = M.mix(df, seed=7).collect()
    assert sorted(map(key, other)) != sorted(map(key, got))


def test_apportionment_equals_seat_by_seat(spark):
    r = random.Random(1)
    for trial in range(4):
        w = {f"p{i}": r.choice([0, 1, 5, 50, 999]) + i for i in range(30)}
        seats = r.choice([0, 3, 57, 400])
        most = {p: r.choice([10**6, 10**6, 1000]) for p in w}
        df = spark.createDataFrame([(p, float(x), seats, most[p]) for p, x in w.items()], "p string, w double, s long, m long")
        got = {x.p: x.quota for x in M.sainte_lague(df, [], "w", "s", "m").collect()}
        want = webster(w, seats, most)
        assert sum(got.values()) == seats
        # ties aside the same seats: no quotient left out exceeds one that won
        won = [Fraction(w[p]) / (2 * got[p] - 1) for p in w if got[p]]
        lost = [Fraction(w[p]) / (2 * got[p] + 1) for p in w if got[p] < most[p]]
        assert not won or min(won) >= max(lost), trial
        assert all(abs(got[p] - want[p]) <= 1 for p in w)


def test_large_party_against_thousands_of_small_ones(spark):
    rows = [("big", 1000.0, 1600, 10**6)] + [(f"p{i}", 0.3, 1600, 10**6) for i in range(2000)]
    got = {x.p: x.quota for x in M.sainte_lague(spark.createDataFrame(rows, "p string, w double, s long, m long"), [], "w", "s", "m").collect()}
    assert got.pop("big") == 1600 and not any(got.values())
    r = random.Random(3)
    w = {f"p{i}": r.choice([1, 2, 3, 7, 1000]) * r.random() for i in range(3000)} | {"big": 5000.0}
    most = {p: r.choice([1, 5, 10**6]) for p in w}
    rows = [(p, x, 7000, most[p]) for p, x in w.items()]
    got = {x.p: x.quota for x in M.sainte_lague(spark.createDataFrame(rows, "p string, w double, s long, m long").repartition(5), [], "w", "s", "m").collect()}
    want = dict.fromkeys(w, 0)
    heap = [(-x, p) for p, x in w.items()]
    heapq.heapify(heap)
    for _ in range(7000):
        while want[heap[0][1]] >= most[heap[0][1]]:
            heapq.heappop(heap)
        p = heap[0][1]
        want[p] += 1
        heapq.heapreplace(heap, (-w[p] / (2 * want[p] + 1), p))
    assert got == want


def test_groups_ties_and_narrowing(spark, monkeypatch):
    monkeypatch.setattr(M, "FEW", 20)
    monkeypatch.setattr(shared, "LOOKUP_ROWS", 0)
    r = random.Random(9)
    rows = []
    for g, n in (("a", 500), ("b", 3), (None, 200), ("zero", 4)):
        seats = {"a": 1300, "b": 5000, None: 77, "zero": 9}[g]
        rows += [(g, f"{g}{i}", 0.0 if g == "zero" else 2.0 if g == "a" else r.random(), seats, 10) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, p string, w double, s long, m long")
    got = M.sainte_lague(df, ["g"], "w", "s", "m").collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, M.sainte_lague(df.repartition(9), ["g"], "w", "s", "m").collect()))
    by = lambda g: {x.p: x.quota for x in got if x.g == g}
    assert sorted(by("a").values()) == [2] * 200 + [3] * 300 and set(by("b").values()) == {10} and set(by("zero").values()) == {0}
    assert by(None) == webster({x.p: Fraction(x.w) for x in got if x.g is None}, 77, {p: 10 for p in by(None)})


def test_numbers_follow_the_order(spark):
    rows = [(s,) for s in ["b", None, "a", "é", "Z", ""]] + [(f"s{i}",) for i in range(500)]
    got = M.numbered(spark.createDataFrame(rows, "s string"), "place", F.col("s").asc_nulls_last()).collect()
    order = sorted((s for (s,) in rows), key=lambda s: (s is None, (s or "").encode()))
    assert {x.s: x.place for x in got} == {s: i for i, s in enumerate(order)}


def test_sizes_and_targets_equal_sql(spark):
    at = "/root/testdata/sf0.01/documents.parquet"
    want = duckdb.sql(rf"""WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM '{at}'),
        s AS (SELECT source, sum(size) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
        r(round, source, source_size, weight, capped) AS (SELECT 0, *, false FROM s UNION ALL
          SELECT round + 1, source, source_size, weight, 3 * source_size * sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () < weight * (sum(source_size) OVER () - sum(CASE WHEN capped THEN 3 * source_size ELSE 0 END) OVER ()) FROM r WHERE round < 40),
        t AS (SELECT source, source_size, CASE WHEN capped THEN 3.0 * source_size ELSE CAST(weight * (sum(source_size) OVER () - sum(CASE WHEN capped THEN 3 * source_size ELSE 0 END) OVER ()) AS DOUBLE) / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () END AS target FROM r WHERE round = 40)
        SELECT doc_id, size, source_size, target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source""").fetchall()
    got = {x.doc_id: x for x in M.mix(spark.read.parquet(at)).collect()}
    assert len(got) == len(want) and all((got[d].size, got[d].source_size) == (n, m) and abs(got[d].target - t) < 1e-6 for d, n, m, t in want)


def test_equal_rows_lie_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(M, "SHARD_DOCS", 50)
    monkeypatch.setattr(M, "COPIES", 7)
    rows = [(None, "w " * 20, "a")] * 600 + [(i, "w " * 20, "b") for i in range(300)]
    got = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 900 and len({r.taken for r in got if r.source == "a"}) > 2
    for s in "ab":
        assert abs(sum(r.taken for r in got if r.source == s) - next(r.target for r in got if r.source == s)) <= 32 * 13


def test_empty(spark):
    assert M.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    none = M.mix(spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")).collect()
    assert [r.taken for r in none] == [0, 0]
