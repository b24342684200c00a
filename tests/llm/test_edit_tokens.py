import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pulsegrid.llm import edit_tokens as E

COUNTER = E.Counter(*E.default_vocabulary())
ALPHABET = "ab é1 \n'tsre!.#中 "


@settings(max_examples=400, deadline=None)
@given(st.text(ALPHABET, max_size=80), st.lists(st.tuples(st.integers(0, 90), st.integers(0, 90), st.text(ALPHABET, max_size=12)), max_size=5))
def test_edits_equal_full_encoding(text, edits):
    tree, now = E.Tree(text, COUNTER), text
    assert tree.n_tokens == COUNTER.count(text)
    for a, b, new in edits:
        a = min(a, len(now))
        b = max(a, min(b, len(now)))
        now = now[:a] + new + now[b:]
        tree.edit(a, b, new)
        assert tree.text == now and tree.n_tokens == COUNTER.count(now) == sum(sum(x[1]) for x in tree.leaves)


def test_long_texts_reencode_little():
    r = random.Random(2)
    text = " ".join(r.choice(["alpha", "beta's", "1,234", "gamma.", "\n\n", "x  y"]) for _ in range(20000))
    tree, now = E.Tree(text, COUNTER), text
    for _ in range(40):
        a = r.randrange(len(now))
        b = min(len(now), a + r.randrange(20))
        new = r.choice(["", "new word", "  ", "'re", "9" * 50, "z " * 2000])
        n = tree.edit(a, b, new)
        now = now[:a] + new + now[b:]
        assert tree.n_tokens == COUNTER.count(now)
        assert n <= 2500
    assert tree.depth < 14


def test_operator(spark, docs_small):
    df = spark.createDataFrame([(d, t, "clash", [(0, 3, "xyz é"), (10**6, 10**6, " end"), (1, 0, None)] if d != 7 else None) for d, t, *_ in docs_small], "doc_id long, text string, n_tokens string, e array<struct<start:int,stop:int,new:string>>")
    for r, (_, t, *_) in zip(sorted(E.edited_counts(df, "e").collect(), key=lambda r: str(r.doc_id)), sorted(docs_small, key=lambda x: str(x[0])), strict=True):
        t = t or ""
        after = t if r.doc_id == 7 else "xyz é" + t[3:] + " end"
        assert (r.n_tokens, r.n_tokens_after) == (COUNTER.count(t), COUNTER.count(after))
    assert E.edited_counts(df.limit(0), "e").count() == 0
