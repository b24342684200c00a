import random
import re
from collections import Counter

import pytest
from pulsegrid.llm import decontam as D

ITEMS = [
    (1, "On Monday Anna bought 12 kg of apples for 30 euros while Peter sold 7 baskets near the old town bridge before noon."),
    (2, "the shared opening of all questions is always the same but its end differs in every single one of them here"),
    (3, "too short"), (4, None), (5, ""), (6, "five words are just enough"),
]
FILLER = "some ordinary text that has nothing to do with any question at all and goes on for quite a while without end "


def rows():
    plain = ITEMS[0][1]
    new = "On Monday Maria bought 45 kg of apples for 99 euros while Oscar sold 3 baskets near the old town bridge before noon."
    mixed = "On Monday Maria bought 45 kg of pears and plums, said Oscar, 3 of which fell into a river near the old mill."
    return [
        (10, FILLER + plain + " " + FILLER), (11, new), (12, FILLER), (13, None), (14, ""), (15, mixed), (16, "!! " + plain.replace(" ", "  \n ")),
        (17, "the shared opening of all questions is"), (18, "too short"), (None, plain), (19, FILLER + "five words are just enough"), (20, ITEMS[1][1].upper()), (21, plain.replace(" of ", " of### ")), (10, FILLER),
    ]


def test_leaks_and_clean(spark):
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows()], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in D.leaks(docs, bench).collect()}
    assert set(got) == {(10, 1), (11, 1), (16, 1), (None, 1), (19, 6), (20, 2), (21, 1), (18, 3)}
    assert got[11, 1].reparameterised and not got[10, 1].reparameterised and got[10, 1].coverage > 0.9  # the first word, inside a sentence there, reads as a name
    left = D.clean(docs, bench)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [10, 12, 13, 14, 15, 17]
    assert D.leaks(docs.limit(0), bench).count() == 0 and D.leaks(docs, bench.limit(0)).count() == 0
    assert D.clean(docs, bench.limit(0)).count() == len(rows())


def test_a_shuffled_join_gives_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    one = sorted(map(str, D.leaks(docs, bench).collect()))
    left = sorted(map(str, D.clean(docs, bench).collect()))
    monkeypatch.setattr(D, "LOOKUP_ROWS", 0)
    monkeypatch.setattr(D, "FILTER_BITS", 4)  # a filter that lets nearly all pass
    assert sorted(map(str, D.leaks(docs, bench).collect())) == one and sorted(map(str, D.clean(docs, bench).collect())) == left


def plain_tokens(text):
    """(kind, kind with all capitals as names, value) of each token, word by word."""
    out, stop, number, line = [], True, False, 0
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text or ""):
        core = re.sub(r"^[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+|[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+$", "", m.group())
        if not core:
            continue
        opens = stop or "\n" in text[line : m.start()]
        digit = any(c.isdigit() for c in core)
        named = core[0].isupper() and any(c.islower() or ord(c) > 127 for c in core[1:])
        unit = number and core.lower() in D.UNITS
        kind = 1 if digit else 2 if named and not opens else 3 if unit else 0
        out.append((kind, 1 if digit else 2 if named else 3 if unit else 0, core.lower()))
        stop, number, line = m.group()[-1] in ".!?:", digit, m.end()
    return out


def plain_leaks(items, docs):
    found = {}
    for d, text in docs:
        t = plain_tokens(text)
        for i, other in items:
            own = plain_tokens(other)
            size = min(D.WINDOW, len(own))
            if not size:
                continue
            see = lambda w, r: tuple(x[r] or x[2] for x in w) if r < 2 else tuple(x[2] for x in w)
            places = []
            for p in range(len(t) - size + 1):
                for q in range(len(own) - size + 1):
                    a, b = t[p : p + size], own[q : q + size]
                    slots = [[x[r] for x in b] for r in (0, 1) if size >= D.SHORTEST and sum(x[r] == 0 for x in b) >= min(D.LITERALS, size) and see(b, r) in (see(a, 0), see(a, 1))]
                    if see(a, 2) == see(b, 2):
                        slots.append([x[0] for x in b])
                    if slots:
                        places.append((p - q, q, min(slots, key=lambda k: sum(x > 0 for x in k))))
            covered, meets, longest, piece, last = set(), {}, 0, (0, 0), None
            for shift, q, kinds in sorted(places):
                covered |= set(range(q, q + size))
                piece = (piece[0], q + size) if last == shift and q <= piece[1] else (q, q + size)
                last, longest = shift, max(longest, piece[1] - piece[0])
                for k, kind in enumerate(kinds):
                    if kind:
                        meets.setdefault((kind, own[q + k][2]), Counter())[t[shift + q + k][2]] += 1
            share = len(covered) / len(own)
            steady = sum(v in c or c.most_common(1)[0][1] * 2 > sum(c.values()) for (_, v), c in meets.items())
            if (share >= D.COVER or longest >= D.RUN) and not (meets and steady < D.CONSISTENT * len(meets)):
                found[d, i] = (len({q for _, q, _ in places}), round(share, 9), any(v not in c for (_, v), c in meets.items()))
    return found


@pytest.mark.parametrize("seed", range(3))
def test_all_leaks_equal_brute_force(spark, seed):
    r = random.Random(seed)
    word = lambda: r.choice("the a red kid Anna Bob Carl 5 7 12 kg Kg km runs Runs (sees) old, end. so: É Él x2 !! river\n house".split(" "))
    items = [(k, " ".join(word() for _ in range(r.choice([0, 1, 2, 3, 4, 6, 8, 9, 14, 30, 70])))) for k in range(25)] + [(90, None), (91, "!!"), (92, "1 2 3 4 5 6 7 8 9"), (93, "5 kg red")]
    docs = [(100, None), (101, ""), (102, "so 1 2 3 4 5 6 7 8 9 end"), (103, "He has 5 kg red")]
    for d in range(60):
        body = [word() for _ in range(r.randrange(40))]
        for _ in range(r.choice([0, 1, 1, 2])):
            own = (r.choice(items)[1] or "").split(" ")
            lo = r.randrange(len(own))
            own = [word() if r.random() < r.choice([0, 0.05, 0.2]) else {"Anna": "Zoe", "5": "9"}.get(w, w) if d % 2 else w for w in (own if r.random() < 0.6 else own[lo : lo + 45])]
            at = r.randrange(len(body) + 1)
            body[at:at] = own
        docs.append((d, " ".join(body)))
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = plain_leaks(items, docs)
    assert {(x.doc_id, x.item_id): (x.n_windows, round(x.coverage, 9), x.reparameterised) for x in got} == want
    assert len(got) == len(want) > 20 and any(x.reparameterised for x in got) and any(x.coverage < 1 for x in got)


def test_ids_of_any_type_and_clashing_names(spark):
    from decimal import Decimal

    docs = spark.createDataFrame([(Decimal(7), ITEMS[0][1], "a", "b", 1)], "doc_id decimal(9,2), text string, tk string, IID string, key int")
    for kind, value in (("smallint", 3), ("binary", bytearray(b"x")), ("decimal(5,1)", Decimal("1.5")), ("date", None)):
        bench = spark.createDataFrame([(value, ITEMS[0][1], 1)], f"item_id {kind}, text string, tk int")
        got = D.leaks(docs, bench)
        assert got.schema["item_id"].dataType == bench.schema["item_id"].dataType
        assert [(x.doc_id, x.item_id) for x in got.collect()] == [(Decimal(7), value)]
    left = D.clean(docs.union(docs.withColumn("text", docs.tk)), bench)
    assert left.columns == docs.columns and [tuple(x)[1:] for x in left.collect()] == [("a", "a", "b", 1)]


def test_a_very_long_text(spark):
    text = (FILLER * 20_000) + ITEMS[0][1] + FILLER
    docs = spark.createDataFrame([(1, text), (2, FILLER * 20_000)], "doc_id long, text string")
    assert [tuple(x)[:2] for x in D.leaks(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()] == [(1, 1)]


def test_inconsistent_slots_do_not_match():
    import pyarrow as pa
    from pulsegrid.llm.textkernel import bytes_of

    item = "then Karl gave 5 books to Karl and Karl gave 5 books to Karl while 5 more books went to Karl again"
    index = D.Index([(1, item)])
    swap = lambda names, nums: " ".join(next(names) if w == "Karl" else next(nums) if w == "5" else w for w in item.split())
    same = swap(iter(["Hans"] * 5), iter(["8"] * 3))
    odd = swap(iter(["Hans", "Ida", "Max", "Eva", "Tom"]), iter(["8", "9", "10"]))
    found = [list(index.leaks(*bytes_of(pa.array([t])))) for t in (item, same, odd)]
    assert [len(f) for f in found] == [1, 1, 0] and found[1][0][4]


def test_all_planted_passages_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in D.leaks(docs, bench).collect()}
    items = bench.collect()
    want = {(d.doc_id, i.item_id) for d in docs.collect() for i in items if i.text in (d.text or "")}
    assert want <= got and len({d for d, _ in got}) <= len({d for d, _ in want}) + 2
