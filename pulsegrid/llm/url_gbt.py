"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

Everything that touches rows is DataFrame expressions.  The trees learn from the
URLs that a rule labels, on at most ``sample`` distinct ones (chosen by hash); the driver
sees that sample only as counts per vector of binned features, and the fitted
trees return to the rows as nested CASE expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labels import lowest

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The production rules.
RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict (null where none fits). Of equal texts the first counts."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(sorted(rules, key=lambda r: -len(r.text))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.text).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


FEATURES = ["f_length", "f_depth", "f_digits", "f_entropy", "f_params", "f_labels", "f_hyphens", "f_tld", "f_domain", "f_extension"]
SUFFIXES = {"f_tld": "s_tld", "f_domain": "s_domain", "f_extension": "s_extension"}


def lexical(df: DataFrame) -> DataFrame:
    """Adds the features that need no training, and the suffixes (s_) whose statistics will.

    Length and digit ratio are of the URL up to its query, entropy is that of the
    characters of host and path.
    """
    host, path, url = F.col("host"), F.col("path"), F.coalesce(F.col("url"), F.lit(""))
    body = F.concat(host, path)
    n = F.greatest(F.length(body), F.lit(1))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    parts = F.split(host, r"\.")
    count = lambda c, x: (F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))).cast("double")
    return (
        df.withColumn("_body", body)
        .withColumn("f_length", F.length(body).cast("double"))
        .withColumn("f_depth", F.size(F.array_remove(F.split(path, "/"), "")).cast("double"))
        .withColumn("f_digits", F.length(F.regexp_replace(body, "[^0-9]", "")) / n)
        .withColumn("f_entropy", F.expr("aggregate(transform(array_distinct(filter(split(_body, ''), c -> c <> '')), c -> (length(_body) - length(replace(_body, c, ''))) / length(_body)), cast(0 as double), (a, p) -> a - p * log2(p))"))
        .withColumn("f_params", F.when(query == "", 0.0).otherwise(count(query, "&") + 1))
        .withColumn("f_labels", F.size(F.array_remove(parts, "")).cast("double"))
        .withColumn("f_hyphens", count(host, "-"))
        .withColumn("s_tld", F.element_at(parts, -1))
        .withColumn("s_domain", F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "."))
        .withColumn("s_extension", F.regexp_extract(path, r"(\.[A-Za-z0-9]{1,5}|/)$", 1))
        .drop("_body")
    )


@dataclass
class Tree:
    """A split (feature index, largest bin that goes left, children) or a leaf value."""

    feature: int = -1
    cut: int = 0
    left: Tree | None = None
    right: Tree | None = None
    value: float = 0.0


def _grow(x, rows, grad, hess, bins, depth, least, penalty) -> Tree:
    g, h = sum(grad[i] for i in rows), sum(hess[i] for i in rows)
    best = (1e-6, None)
    if depth:
        for f, n in enumerate(bins):
            sums = [[0.0, 0.0] for _ in range(n)]
            for i in rows:
                s = sums[x[i][f]]
                s[0] += grad[i]
                s[1] += hess[i]
            gl = hl = 0.0
            for b in range(n - 1):
                gl, hl = gl + sums[b][0], hl + sums[b][1]
                if hl < least or h - hl < least:
                    continue
                gain = gl * gl / (hl + penalty) + (g - gl) ** 2 / (h - hl + penalty) - g * g / (h + penalty)
                if gain > best[0]:
                    best = (gain, (f, b))
    if best[1] is None:
        return Tree(value=-g / (h + penalty))
    f, b = best[1]
    left, right = [i for i in rows if x[i][f] <= b], [i for i in rows if x[i][f] > b]
    below = [_grow(x, side, grad, hess, bins, depth - 1, least, penalty) for side in (left, right)]
    return Tree(f, b, *below)


def boost(cells: list[tuple[tuple[int, ...], float, float]], bins: list[int], trees: int = 16, depth: int = 3, rate: float = 0.4, least: float = 1.0, penalty: float = 1.0) -> tuple[float, list[Tree]]:
    """Logistic boosting on (bins of each feature, rows, rows labelled 1); the prior's log odds and the trees."""
    x = [c[0] for c in cells]
    n, pos = sum(c[1] for c in cells), sum(c[2] for c in cells)
    prior = math.log((pos + 0.5) / (n - pos + 0.5))
    z, out = [prior] * len(cells), []

    def value(t: Tree, bins_of) -> float:
        while t.left is not None:
            t = t.left if bins_of[t.feature] <= t.cut else t.right
        return t.value

    for _ in range(trees if 0 < pos < n else 0):
        p = [1 / (1 + math.exp(-v)) for v in z]
        grad = [c[1] * q - c[2] for c, q in zip(cells, p, strict=True)]
        hess = [c[1] * q * (1 - q) for c, q in zip(cells, p, strict=True)]
        t = _grow(x, list(range(len(cells))), grad, hess, bins, depth, least, penalty)
        for i, c in enumerate(cells):
            z[i] += rate * value(t, c[0])
        out.append(t)
    return prior, out


@dataclass
class Model:
    prior: float
    trees: list[Tree]
    edges: list[list[float]]
    suffixes: dict[str, dict[str, float]]
    default: float
    rate: float = 0.4

    def _tree(self, t: Tree) -> Column:
        if t.left is None:
            return F.lit(self.rate * t.value)
        return F.when(F.col(FEATURES[t.feature]) <= self.edges[t.feature][t.cut], self._tree(t.left)).otherwise(self._tree(t.right))

    def add_suffix_features(self, df: DataFrame) -> DataFrame:
        """Log odds of each suffix by joins with the sample's suffixes (at most as many as sampled rows); unseen ones get the prior's."""
        for f, s in SUFFIXES.items():
            known = self.suffixes[f]
            if len(known) <= 64:
                value = F.lit(self.default)
                for k, v in sorted(known.items()):
                    value = F.when(F.col(s) == k, v).otherwise(value)
                df = df.withColumn(f, value)
            else:
                table = df.sparkSession.createDataFrame(sorted(known.items()), f"{s} string, {f} double")
                df = df.join(F.broadcast(table), s, "left").withColumn(f, F.coalesce(f, F.lit(self.default)))
        return df

    def probability(self) -> Column:
        z = F.lit(self.prior)
        for t in self.trees:
            z = z + self._tree(t)
        return 1 / (1 + F.exp(-z))


def fit(labelled: DataFrame, sample: int = 20_000, bins: int = 16) -> Model:
    """Trees from rows with lexical features and ``label`` (1: block), at most ``sample`` distinct URLs; repeated ones count once."""
    cols = FEATURES[: len(FEATURES) - len(SUFFIXES)]
    some = lowest(labelled.select("url", *cols, *SUFFIXES.values(), "label"), F.col("url"), sample)
    rows = [tuple(r) for r in some.groupBy(*cols, *SUFFIXES.values(), "label").agg(F.count("*").cast("double").alias("n")).collect()]  # at most `sample` rows
    n, pos = sum(r[-1] for r in rows), sum(r[-1] for r in rows if r[-2])
    default = math.log((pos + 0.5) / (n - pos + 0.5))
    suffixes: dict[str, dict[str, float]] = {}
    for j, f in enumerate(SUFFIXES):
        counts: dict[str, list[float]] = {}
        for r in rows:
            c = counts.setdefault(r[len(cols) + j], [0.0, 0.0])
            c[1 if r[-2] else 0] += r[-1]
        share = (pos + 0.5) / (n + 1)
        suffixes[f] = {k: math.log((c[1] + 4 * share) / (c[0] + 4 * (1 - share))) for k, c in counts.items()}
    full = [(*r[: len(cols)], *(suffixes[f][r[len(cols) + j]] for j, f in enumerate(SUFFIXES)), r[-2], r[-1]) for r in rows]
    edges = []
    for f in range(len(FEATURES)):
        seen: dict[float, float] = {}
        for r in full:
            seen[r[f]] = seen.get(r[f], 0.0) + r[-1]
        total, cuts, acc = sum(seen.values()), [], 0.0
        for v in sorted(seen)[:-1]:
            acc += seen[v]
            if len(seen) <= bins or acc * bins >= total * (len(cuts) + 1):
                cuts.append(v)
        edges.append(cuts)
    cells: dict[tuple[int, ...], list[float]] = {}
    for r in full:
        key = tuple(sum(r[f] > e for e in edges[f]) for f in range(len(FEATURES)))
        c = cells.setdefault(key, [0.0, 0.0])
        c[0] += r[-1]
        c[1] += r[-1] if r[-2] else 0.0
    prior, trees = boost([(k, *c) for k, c in sorted(cells.items())], [len(e) + 1 for e in edges]) if cells else (default, [])
    return Model(prior, trees, edges, suffixes, default)


def url_filter(pages: DataFrame, rules: list[Rule] | None = None, sample: int = 20_000, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, p_block.

    ``rules`` are few and become expressions.  A null url, or one without ``://``, has
    empty host and path, fits no rule and is judged by the trees.  Repeated rows each
    get a row.  Without labelled URLs of both kinds the trees are empty and the
    smoothed share of blocked ones decides (no labels at all: allow).
    """
    rules = RULES if rules is None else rules
    src = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    name, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    judged = lexical(src.withColumn("rule", name).withColumn("by_rule", verdict))
    model = fit(judged.where(F.col("rule").isNotNull()).withColumn("label", (F.col("by_rule") == "block").cast("int")), sample)
    out = model.add_suffix_features(judged).withColumn("p_block", model.probability())
    decided = F.coalesce("by_rule", F.when(F.col("p_block") > 0.5, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", decided.alias("verdict"), "p_block")
