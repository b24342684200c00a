import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pulsegrid.llm import rule_ledger as L
from pulsegrid.llm import textkernel as K

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    rep = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(rep), "n_upper_words": sum(len(re.findall("[A-Z]", x)) >= 2 and not re.search("[a-z]", x) for x in w),
    }


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab é\n\x0b#A ", max_size=40)), max_size=8))
def test_measure_equals_brute_force(texts):
    got = L.measure(*K.bytes_of(pa.array(texts, pa.string())))
    for i, t in enumerate(texts):
        assert {m: int(got[m][i]) for m in L.MEASURES} == brute(t)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("abC \n", max_size=30)), max_size=6))
def test_shingles_equal_brute_force(texts):
    words = K.Words(*K.bytes_of(pa.array(texts, pa.string())))
    vals, first = K.shingle_sets(words, 4)
    seen = {}
    for i, t in enumerate(texts):
        w = WORD.findall((t or "").lower())
        want = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
        have = vals[first[i] : first[i + 1]]
        assert len(have) == len(want)
        key = frozenset(have.tolist())
        assert seen.setdefault(key, want) == want


def test_ledger_policies_and_ablations(spark, docs_small):
    df = spark.createDataFrame(docs_small, "doc_id long, text string, lang string, source string, n_words long")
    led = L.ledger(df)
    assert led.columns.count("n_words") == 1 and led.count() == len(docs_small)
    rows = led.select("doc_id", "failed_bits", L.passes("web-1").alias("kept")).collect()
    assert all(r["failed_bits"] & 1 for r in rows if r["doc_id"] in (3, 4, 5, 6))
    total = {r["rule"]: r.asDict() for r in L.ablations(led, "web-1").collect()}
    assert total["few_words"]["n_failed"] == sum(bool(r["failed_bits"] & 1) for r in rows)
    assert total["few_words"]["n_kept_without"] == sum(r["failed_bits"] & L.POLICIES["web-1"] in (0, 1) for r in rows)
    assert L.ledger(df.limit(0)).count() == 0


def test_segmented_hashes_do_not_depend_on_place():
    buf = np.frombuffer(b"abc " * 1000, np.uint8)
    w = K.Words(buf, np.array([0, len(buf)]))
    assert len(np.unique(K.span_hashes(buf, w.starts, w.ends, segment=7))) == 1
