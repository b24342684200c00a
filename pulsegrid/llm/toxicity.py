"""Toxicity by a weighted finite-state pattern grammar.

Words become class symbols by a lexicon of words and stems (insults in four
strengths, threat verbs in two, targets, negations, reporting verbs).  Each clause's
symbols then run through a composition of letter-to-letter transducers

    negation o reported speech o threat o target

whose arc weights add up to the clause's score: an insult near a target counts
more, a threat verb counts only when a target follows, a negated or reported one
counts less.  A clause ends at .!?;: or the line; after a colon and inside quotation
marks only the report lives on, as what was said is still reported there.  A logistic link over the matched clauses of a text gives its
probability.  Insult words and stems beyond the small fixed lexicon, and the
link, are learned from labelled rows; the bounds of that sample are parameters.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import held_out, labelled_sample
from .scratch import unused
from .textkernel import EXACT, IS_CORE, U64, Words, bytes_of, fold_latin, slices, span_hashes

# The seed lexicon, lower case.
INSULTS = "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown clowns imbecile idiota imbécil estúpido basura abruti connard crétin ordure dummkopf abschaum arschloch trottel".split()
THREATS = "kill destroy murder stab tuer matar töten umbringen".split()
WEAK_THREATS = "hurt shoot burn beat frapper golpear schlagen".split()  # also said of games, cameras and bread
TARGETS = "you your u he she him her they them these those tu vous toi te usted ustedes tú du dich ihr euch sie".split()
NEGATIONS = "not no never isn't aren't wasn't don't nobody nicht kein keine nie pas jamais nunca ningún".split()
REPORTS = "said says say called calls quoted quote reported wrote claimed sagte dit dijo genannt appelé llamó".split()

SYMBOLS = ["o", "1", "2", "3", "4", "T", "P", "N", "R", "W", "B"]  # other, insults by strength, threat verb, target, negation, report, weak threat verb, a boundary that a report crosses
STRENGTH = {"1": 1.0, "2": 2.0, "3": 3.0, "4": 4.0}
NEAR = 3


@dataclass(frozen=True)
class Transducer:
    """A deterministic letter-to-letter transducer: ``arcs[state, symbol] = (next state, output, weight)``; unlisted symbols pass by ``rest``."""

    start: object
    arcs: dict = field(hash=False)

    def step(self, state, symbol):
        return self.arcs[state, symbol]

    def run(self, symbols) -> tuple[list[str], float]:
        state, out, weight = self.start, [], 0.0
        for s in symbols:
            state, o, w = self.arcs[state, s]
            out.append(o)
            weight += w
        return out, weight


def build(start, alphabet, rule) -> Transducer:
    """All arcs reachable from ``start`` under ``rule(state, symbol) -> (next, output, weight)``."""
    arcs, todo, seen = {}, [start], {start}
    while todo:
        q = todo.pop()
        for a in alphabet:
            nxt, out, w = arcs[q, a] = rule(q, a)
            if nxt not in seen:
                seen.add(nxt)
                todo.append(nxt)
    return Transducer(start, arcs)


def compose(first: Transducer, second: Transducer, alphabet) -> Transducer:
    """The transducer that feeds the first one's output to the second; weights add."""

    def rule(state, a):
        p, mid, w1 = first.arcs[state[0], a]
        q, out, w2 = second.arcs[state[1], mid]
        return (p, q), out, w1 + w2

    return build((first.start, second.start), alphabet, rule)


def _tags(symbol: str) -> tuple[str, str]:
    return symbol[0], symbol[1:]


_HIT = ("1", "2", "3", "4", "T", "W")


def _negation() -> Transducer:
    def rule(left, a):
        if a in "NB":
            return NEAR if a == "N" else 0, a, 0.0
        return max(0, left - 1), a + "n" if left and a in _HIT else a, 0.0

    return build(0, SYMBOLS, rule)


def _reported(alphabet) -> Transducer:
    def rule(told, a):
        return told or a == "R", a + "r" if told and _tags(a)[0] in _HIT else a, 0.0

    return build(False, alphabet, rule)


def _threat(alphabet) -> Transducer:
    """A threat verb becomes a hit, a strong one unless the verb is weak, at the target that follows it within three words."""

    def rule(state, a):
        left, verb = state
        kind, _ = _tags(a)
        if kind in "TW":
            return (NEAR, a), "o", 0.0
        if kind == "P" and left:
            return (0, ""), ("4" if verb[0] == "T" else "2") + verb[1:] + "t", 1.0 if verb[0] == "T" else 0.0
        if kind == "B":
            return (0, ""), a, 0.0
        return (max(0, left - 1), verb if left > 1 else ""), a, 0.0

    return build((0, ""), alphabet, rule)


def _target(alphabet) -> Transducer:
    """Weights: an insult's strength, lowered by negation or report, raised by a target up to three words before it."""

    def rule(left, a):
        kind, tags = _tags(a)
        if kind in "PB":
            return NEAR if kind == "P" else 0, kind, 0.0
        if kind in STRENGTH:
            w = STRENGTH[kind] * (0.25 if "n" in tags else 1.0) * (0.5 if "r" in tags else 1.0)
            return max(0, left - 1), "hit", w + (0.25 * w if left else 0.0)
        return max(0, left - 1), "o", 0.0

    return build(0, alphabet, rule)


def grammar() -> Transducer:
    """The composed transducer over ``SYMBOLS``."""
    negation = _negation()
    outs = sorted({o for _, o, _ in negation.arcs.values()})
    two = compose(negation, _reported(outs), SYMBOLS)
    outs = sorted({o for _, o, _ in two.arcs.values()})
    three = compose(two, _threat(outs), SYMBOLS)
    outs = sorted({o for _, o, _ in three.arcs.values()})
    return compose(three, _target(outs), SYMBOLS)


# ---------------------------------------------------------------- lexicon


def _key(word: bytes) -> int:
    a = np.frombuffer(word, np.uint8)
    return int(span_hashes(a, np.array([0]), np.array([len(a)]), EXACT)[0])


class Lexicon:
    """Symbols of whole words and of stems, looked up by hash for all words of a slice at once."""

    def __init__(self, words: dict[str, str], stems: dict[str, str]):
        self.words, self.stems = words, stems
        self.tables = [(0, *self._table(words))] if words else []
        for n in sorted({len(s.encode()) for s in stems}):
            self.tables.append((n, *self._table({s: c for s, c in stems.items() if len(s.encode()) == n})))

    @staticmethod
    def _table(entries):
        rows = sorted((_key(w.encode()), SYMBOLS.index(c)) for w, c in entries.items())
        return np.array([r[0] for r in rows], U64), np.array([r[1] for r in rows], np.int8)

    def symbols(self, folded: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        out = np.zeros(len(lo), np.int8)
        for n, keys, kinds in self.tables:
            at = np.flatnonzero(hi - lo >= max(n, 1))
            h = span_hashes(folded, lo[at], (lo[at] + n) if n else hi[at], EXACT)
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = (keys[k] == h) & (out[at] == 0)
            out[at[hit]] = kinds[k[hit]]
        return out


_STRONG = np.array([c in "1234TW" for c in SYMBOLS])
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b".!?;:")] = True

#: What a text's matched clauses give the link: log of 1 + summed scores, largest clause score, matched clauses per word.
FEATURES = 3


def clause_features(buf: np.ndarray, off: np.ndarray, lexicon: Lexicon, fst: Transducer) -> np.ndarray:
    """One row of features per text; only clauses with an insult or threat verb are run through the grammar."""
    words = Words(buf, off)
    out = np.zeros((len(words.n), FEATURES))
    if not len(words.starts):
        return out
    lo, hi = words.cores()
    sym = lexicon.symbols(fold_latin(buf), lo, hi)
    strong = _STRONG[sym]
    if not strong.any():
        return out
    row = words.row()
    hard, soft = boundaries(buf, words)
    clause = np.cumsum(hard) - 1
    hot = np.zeros(clause[-1] + 1, bool)
    hot[clause[strong]] = True
    use = np.flatnonzero(hot[clause])
    use = use[_in_reach(use, clause, strong)]
    cut = np.flatnonzero(np.diff(clause[use], prepend=-1))
    codes, breaks = sym[use], soft[use]
    arcs, start = fst.arcs, fst.start
    total, most, n = np.zeros(len(words.n)), np.zeros(len(words.n)), np.zeros(len(words.n))

    def add(r, score):
        if score > 0:
            total[r] += score
            most[r] = max(most[r], score)
            n[r] += 1

    for a, b in zip(cut, [*cut[1:], len(use)], strict=True):
        state, score, r = start, 0.0, row[use[a]]
        for c, broken in zip(codes[a:b].tolist(), breaks[a:b].tolist(), strict=True):
            if broken:
                add(r, score)
                state, score = arcs[state, "B"][0], 0.0
            state, _, w = arcs[state, SYMBOLS[c]]
            score += w
        add(r, score)
    out[:, 0], out[:, 1], out[:, 2] = np.log1p(total), most, 10 * n / np.maximum(words.n, 1)
    return out


def boundaries(buf: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Whether a clause, and all that was told, ends before each word; and whether a clause ends there that a report crosses.

    A clause ends at a new row or line and behind .!?;: with or without a closing quotation
    mark.  It is crossed after a colon, and where a quotation of the line is still open.
    """
    row, starts, ends = words.row(), words.starts, words.ends
    byte = lambda at: buf[np.maximum(at, 0)]
    lines = np.concatenate(([0], np.cumsum(buf == 10)))
    new = np.ones(len(row), bool)
    new[1:] = (lines[starts[1:]] != lines[starts[:-1]]) | (row[1:] != row[:-1])
    # open quotations before each word, since its line or row began
    pair = lambda lead, b: np.flatnonzero((buf[:-1] == lead) & (buf[1:] == b)) if len(buf) > 1 else np.zeros(0, np.int64)
    curly = pair(0x80, 0x9C), pair(0x80, 0x9D), pair(0x80, 0x9E)
    own = np.searchsorted(words.off, curly[0], "right") - 1
    low = np.zeros(len(words.n) + 1, bool)
    low[np.searchsorted(words.off, curly[2], "right") - 1] = True  # rows with low opening marks, whose high ones close
    # the last sign of the word before, a closing mark left aside
    last = ends[:-1] - 1
    shut = (buf[last] == 0x9D) | ((buf[last] == 0x9C) & low[row[:-1]])
    at = np.where((buf[last] == 0x22) | (buf[last] == 0x29), last - 1, np.where(shut & (byte(last - 1) == 0x80) & (byte(last - 2) == 0xE2), last - 3, np.where((buf[last] == 0xBB) & (byte(last - 1) == 0xC2), last - 2, last)))
    sign = np.where(at >= starts[:-1], byte(at), 0).astype(np.uint8)
    step = np.zeros(len(buf) + 1, np.int64)
    for places, value in ((curly[0], np.where(low[own], -1, 1)), (curly[1], -1), (curly[2], 1), (pair(0xC2, 0xAB), 1), (pair(0xC2, 0xBB), -1)):
        step[places + 1] += value
    depth, straight = np.cumsum(step), np.concatenate(([0], np.cumsum(buf == 0x22)))
    first = starts[np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))]  # the first word of the line
    inside = ((straight[starts] - straight[first]) % 2 == 1) | (depth[starts] - depth[first] > 0)
    soft = np.zeros(len(row), bool)
    soft[1:] = _PUNCT[sign] & ~new[1:] & ((sign == 58) | inside[1:])
    hard = new.copy()
    hard[1:] |= _PUNCT[sign] & ~soft[1:]
    return hard, soft


def _in_reach(use: np.ndarray, clause: np.ndarray, strong: np.ndarray) -> np.ndarray:
    """All words of a hot clause matter (a report may stand anywhere before the hit); those after its last hit and its reach do not."""
    last = np.zeros(clause[-1] + 1, np.int64)
    np.maximum.at(last, clause[strong], np.flatnonzero(strong))
    return use <= last[clause[use]] + NEAR


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    lexicon: Lexicon
    fst: Transducer
    weights: np.ndarray  # bias last

    def probability(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        x = clause_features(buf, off, self.lexicon, self.fst)
        return sigmoid(x @ self.weights[:-1] + self.weights[-1])


_SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def _core(word: str) -> str:
    b = word.encode()
    keep = [i for i, c in enumerate(b) if IS_CORE[c]]
    return fold_latin(np.frombuffer(b[keep[0] : keep[-1] + 1], np.uint8)).tobytes().decode() if keep else ""


def learn_lexicon(sample: list[tuple[str, int]], least: int = 4, odds: float = 20.0, weak: float = 6.0) -> tuple[dict[str, str], dict[str, str]]:
    """Insult words and stems (4 to 8 letters): greedily, those that mark most labelled texts not yet explained.

    A candidate must occur in ``least`` toxic texts and be ``odds`` times likelier
    there, or in five times as many and be ``weak`` times likelier; its strength
    follows those odds.  Taking only what explains further texts keeps out words that
    merely stand beside insults, as in groups of copies.
    """
    n = [sum(y == k for _, y in sample) for k in (0, 1)]
    if not n[0] or not n[1]:
        return {}, {}
    toxic: list[set] = []
    counts = [Counter(), Counter()]
    for text, y in sample:
        words = {_core(w) for w in _SPLIT.findall(text)} - {""}
        found = words | {w[:k] + "*" for w in words for k in range(4, 9) if len(w) > k}
        counts[y].update(found)
        if y:
            toxic.append(found)
    rate = lambda w: ((counts[1][w] + 0.1) / (n[1] + 1)) / ((counts[0][w] + 0.1) / (n[0] + 1))
    good = {w: rate(w) for w, c in counts[1].items() if c >= least and rate(w) >= (odds if c < 5 * least else weak)}
    where: dict[str, list[int]] = {}
    for i, found in enumerate(toxic):
        for w in found & good.keys():
            where.setdefault(w, []).append(i)
    least = max(least, len(toxic) // 200)
    known = set(INSULTS)
    words, stems, done = {}, {}, np.array([float(bool(found & known)) for found in toxic])
    while where:
        gain = {w: int((done[ids] < 1).sum()) for w, ids in where.items()}
        w = max(gain, key=lambda w: (gain[w] * np.log(good[w]), "*" not in w, -len(w), w))
        if gain[w] < least:
            break
        strength = sum(good[w] >= x for x in (12, 30, 100))
        (stems if w[-1] == "*" else words)[w.rstrip("*")] = "1234"[strength]
        done[where.pop(w)] += (0.25, 0.25, 0.5, 0.5)[strength]  # two strong entries explain a text
        if w[-1] == "*":
            for other in [o for o in where if o.startswith(w[:-1])]:
                del where[other]
    return words, stems


def fit_link(x: np.ndarray, y: np.ndarray, penalty: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton's method; the bias comes last."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-3
    for _ in range(50):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(sample: list[tuple[str, int]]) -> Model:
    """A model from labelled texts; with one label or none, the fixed lexicon and a cautious link."""
    words, stems = learn_lexicon(sample)
    lexicon = {w: c for c, ws in (("R", REPORTS), ("N", NEGATIONS), ("P", TARGETS), ("T", THREATS), ("W", WEAK_THREATS), ("3", INSULTS)) for w in ws} | words
    lex, fst = Lexicon(lexicon, stems), grammar()
    if len({y for _, y in sample}) < 2:
        return Model(lex, fst, np.array([1.0, 1.0, 0.0, -4.0]))
    x = np.vstack([clause_features(*bytes_of(pa.array([t for t, _ in sample[i : i + 500]], pa.string())), lex, fst) for i in range(0, len(sample), 500)])
    return Model(lex, fst, fit_link(x, np.array([y for _, y in sample], float)))


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default, but the text) and ``score``: the probability that a text is toxic.

    Null and empty texts get the link's value without any match. Repeated rows each get a row.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (text, "score")]
    whole = unused("text", keep)
    src = docs.select(*keep, F.col(text).alias(whole))
    shared = docs.sparkSession.sparkContext.broadcast((model.lexicon.words, model.lexicon.stems, model.weights))

    def run(batches):
        words, stems, weights = shared.value
        own = Model(Lexicon(words, stems), grammar(), weights)
        for part, buf, off in slices(batches, whole):
            yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(own.probability(buf, off))], names=[*keep, "score"])

    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != whole] + ["score double"])
    return src.mapInArrow(run, fields)


def toxicity(docs: DataFrame, labels: DataFrame, mod: int = 5, remainder: int = 0, per_class: int = 2000, max_chars: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; learns from at most ``per_class`` texts of each label that are not held out.

    Null and empty texts match nothing and get the link's value for that; rows without an id
    are held out; equal texts get equal scores; repeated rows each get a row.  Without labels
    of both kinds the fixed lexicon decides.  Other columns play no part.
    """
    model = train(labelled_sample(docs, labels, "toxic", mod, remainder, per_class, max_chars))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id", mod, remainder).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
