"""Held-out accuracy and edge cases of the learned operators."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pulsegrid.llm import byte_cnn as C
from pulsegrid.llm import toxicity as T
from pulsegrid.llm.textkernel import bytes_of

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_grammar_scores_clauses():
    fst = T.grammar()
    score = lambda s: fst.run(s)[1]
    assert score("oo3o") == 3.0
    assert score("P3") > score("3") > score("R3") > score("N3") > 0
    assert score("T") == 0 and score("TP") > 3 and score("TooooP") == 0
    assert score("NTP") < score("TP") and score("RTP") < score("TP")
    assert score("33") == 6.0 and score("ooo") == 0


def test_composition_equals_running_in_turn():
    a, outs = T._negation(), sorted({o for _, o, _ in T._negation().arcs.values()})
    b = T._reported(outs)
    both = T.compose(a, b, T.SYMBOLS)
    for s in ("N3oR4", "RNT3", "ooNooo2"):
        mid, w = a.run(s)
        out, v = b.run(mid)
        assert both.run(s) == (out, w + v)


def test_toxicity_on_held_out_texts(tables):
    docs, labels = tables
    got = T.toxicity(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.9
    assert T.toxicity(docs, labels).count() == docs.count()


def test_toxicity_without_labels(spark, docs_small):
    df = spark.createDataFrame([(d, t, "c") for d, t, *_ in docs_small] + [(90, "You are an idiot, you stupid MORON!", "c")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = T.toxicity(df, none).collect()
    assert len(got) == len(docs_small) + 1 and all(0 <= r.score <= 1 for r in got)
    assert [r.doc_id for r in got if r.predicted] == [90]
    assert C.quality(df, none).count() == len(got)


def test_quality_on_held_out_texts(tables):
    docs, labels = tables
    got = C.quality(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.9


def test_chunks_cover_whole_texts():
    net = C.train([("plain words here " * 9, 1), ("### !!! " * 20, 0)] * 6, epochs=2)
    r = np.random.default_rng(0)
    b = r.integers(32, 127, 5000).astype(np.uint8)
    assert C.probability(net, b) == net.probability(b)
    assert C.probability(net, b, stretch=2 * C.HALF) == pytest.approx(net.probability(b), abs=1e-6)
    assert 0 <= net.probability(b[:0]) <= 1
    moved = b.copy()
    moved[-3:] = 35
    assert not np.array_equal(net.halves(moved)[-1], net.halves(b)[-1])


def test_training_lowers_the_loss():
    sample = [("good text with words " * 5, 1), ("### *** $$$ %%%", 0)] * 10
    early, late = C.train(sample, epochs=1), C.train(sample, epochs=8)
    loss = lambda n: -sum(np.log(max(1e-9, p if y else 1 - p)) for t, y in sample for p in [n.probability(np.frombuffer(t.encode(), np.uint8))])
    assert loss(late) < loss(early)


def test_cores_and_folding():
    buf, off = bytes_of(pa.array(["ÉCOLE!! (Ünï) ... a", None]))
    words = T.Words(buf, off)
    folded = T.fold_latin(buf).tobytes()
    lo, hi = words.cores()
    assert [folded[a:b].decode() for a, b in zip(lo, hi, strict=True)] == ["école", "ünï", "", "a"]


def plain_features(text, words, stems):
    """The grammar's features word by word, without transducers."""
    kinds = {w.encode(): c for w, c in words.items()}
    starts = sorted(((s.encode(), c) for s, c in stems.items()), key=lambda x: (len(x[0]), x[0]))
    total = most = clauses = n = 0

    def symbol(word):
        b = re.sub(rb"^[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+|[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+$", b"", word.lower().encode())
        return kinds.get(b) or next((c for s, c in starts if b.startswith(s)), "o") if b else "o"

    def ends():
        nonlocal total, most, clauses, score
        if score > 0:
            total, most, clauses = total + score, max(most, score), clauses + 1
        score = 0.0

    low = "„" in text
    for line in text.split("\n"):
        told = denied = aimed = near = score = 0
        verb, quote, depth, before = "", 0, 0, ""
        for word in re.findall(r"[^\x20\x09-\x0D]+", line):
            n += 1
            if before:
                sign = before[-2:-1] if before[-1] in "\")”»" or (low and before[-1] == "“") else before[-1]
                if before[-1] == "“" and not low:
                    sign = "“"
                if sign and sign in ".!?;:":
                    ends()
                    denied = aimed = near = 0
                    if not (sign == ":" or quote % 2 or depth > 0):
                        told = 0
            before = word
            quote += word.count('"')
            depth += sum(word.count(c) for c in "«„") + word.count("“") * (-1 if low else 1) - sum(word.count(c) for c in "»”")
            s = symbol(word)
            factor = (0.25 if denied else 1) * (0.5 if told else 1)  # as it stands before this word
            hit = None
            if s == "N":
                denied, hit_denied = 3, True
            else:
                hit_denied, denied = denied > 0, max(0, denied - 1)
            if s == "R":
                told = 1
            if s in "TW":
                near, verb, kept = 3, s, factor
            elif s == "P" and near:
                hit, factor, extra, near = (4, kept, 1.0, 0) if verb == "T" else (2, kept, 0.0, 0)
            else:
                near = max(0, near - 1)
                if s in "1234":
                    hit, extra = int(s), 0.0
            if hit:
                own = hit * factor
                score += extra + own + (0.25 * own if aimed else 0)
            aimed = 3 if s == "P" and not hit else max(0, aimed - 1)
        ends()
    return [np.log1p(total), most, 10 * clauses / max(1, n)]


def test_scores_equal_a_plain_version(spark):
    m = T.train([])
    lexicon = T.Lexicon(m.lexicon.words | {"weed": "1", "rotten": "2", "grim": "4"}, {"dumm": "4", "fool": "1"})
    vocabulary = ["you", "du", "idiot", "stupid", "weed", "rotten", "grim", "dummes", "foolish", "kill", "beat", "not", "never", "said", "wrote", "the", "a", "rain", "É", "…", "-"]
    r = random.Random(4)
    texts = [None, "", " \n ", "he said: you idiot", 'he said "you idiot. you fool." you idiot', "I will beat you at chess", "I will kill you"]
    for _ in range(600):
        out = []
        for _ in range(r.randrange(25)):
            w = r.choice(vocabulary)
            w = w.upper() if r.random() < 0.1 else w
            out.append(r.choice(["", "", "", '"', "“", "„", "«", "("]) * (r.random() < 0.3) + w + r.choice(["", "", ".", "!", ":", ",", ";", '."', '"', '".', ".”", ".“", "“", "»", ".»", ")", "?)"]) * (r.random() < 0.5))
            out.append(r.choice([" ", " ", " ", "\n", "\t"]))
        texts.append("".join(out))
    texts.append("rain " * 200_000 + "you idiot " + "he said: " + "you fool. " * 3)
    got = T.clause_features(*bytes_of(pa.array(texts, pa.string())), lexicon, m.fst)
    for text, features in zip(texts, got, strict=True):
        assert features == pytest.approx(plain_features(text or "", lexicon.words, lexicon.stems)), text
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id int, text string, Text0 string")
    weights = np.array([1.0, 0.5, 0.2, -3.0])
    for x in T.score(df, T.Model(lexicon, m.fst, weights)).collect():
        z = float(np.array(plain_features(texts[x.doc_id] or "", lexicon.words, lexicon.stems)) @ weights[:3] + weights[3])
        assert x.Text0 == "clash" and x.score == pytest.approx(1 / (1 + np.exp(-z)))


def test_reports_cross_colons_and_quotations():
    m = T.train([])
    most = lambda t: T.clause_features(*bytes_of(pa.array([t])), m.lexicon, m.fst)[0, 1]
    assert most("he said: you idiot") == most("he said you idiot") == most('he said "you idiot. Now you are gone"') == most("you idiot") / 2
    assert most("note: you idiot") == most('he said "x." you idiot') == most("he said. You idiot") == most("he said:\nyou idiot") == most("you idiot")
    assert most("I will beat you at chess") < most("I will kill you") / 2


def plain_network(net, b):
    """The probability of a text, filter by filter and place by place."""
    n = max(1, -(-len(b) // C.HALF))
    byte = lambda i: int(b[i]) if i < len(b) else 0

    def lag(i):
        if i + 3 >= len(b):
            return 0
        return next((d for d in range(1, C.LAGS + 1) if i - d >= 0 and all(b[i + k] == b[i - d + k] for k in range(4))), 0)

    best = np.full((n, C.FILTERS), -np.inf)
    for i in range(0, n * C.HALF, C.STRIDE):
        for f in range(C.FILTERS):
            act = net.bias[f]
            for t, (plane, j) in enumerate(C.TAPS):
                act = np.float32(act + net.tables[t][(lag if plane else byte)(i + j), f])
            best[i // C.HALF, f] = max(best[i // C.HALF, f], act)
    chunks = [np.maximum(np.maximum(best[k], best[k + 1]) if n > 1 else best[k], 0) for k in range(max(1, n - 1))]
    z = sum(net.out[f] * np.mean([c[f] for c in chunks]) + net.out[C.FILTERS + f] * max(c[f] for c in chunks) for f in range(C.FILTERS)) + net.out[-1]
    return 1 / (1 + np.exp(-z))


def test_network_equals_a_plain_version(spark):
    net = C.train([("plain words here " * 9, 1), ("### !!! " * 20, 0)] * 6, epochs=2)
    r = random.Random(6)
    texts = [None, "", "a", "aaaaaaaaaa", "é" * 300, "ab cd " * 200] + ["".join(r.choice("abc #\n") for _ in range(r.choice([3, 255, 256, 257, 700, 1500]))) for _ in range(8)]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id int, text string, _text int")
    for x in C.score(df, net).collect():
        assert x.score == pytest.approx(plain_network(net, (texts[x.doc_id] or "").encode()), abs=1e-5) and x._text == 7
