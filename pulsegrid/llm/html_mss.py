"""Main text of web pages by the maximum-scoring subsequence of their tokens.

A page becomes a sequence of words and tags.  Words score positive and tags
negative; a linear scan finds the contiguous stretch of the largest sum.  Weights
come from labelled pages: those whose authors marked their content with
``<article>`` or ``<main>``.  A word's weight follows the odds that words of its
container (innermost block or classed element) stand inside the marked content; a
tag's cost follows the odds that it stands outside.  The stretch is then widened to
whole blocks and, if it touches a marked element, joined with all marked elements, and
cleaned of what is boilerplate by name: menus, headers, footers, sidebars, notices,
adverts, forms, comments.  Names are whole class or id tokens; an element that is
named so, but without which next to nothing would be left, is no boilerplate.
"""

from __future__ import annotations

import html
import itertools
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import lowest
from .scratch import unused

# Names of elements and of the classes, ids and roles that mark boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT = frozenset(("article", "main"))
DROPPED = frozenset("head script style title textarea noscript template iframe svg xmp nav header footer aside button select dialog menu search object canvas audio video".split())
CONTROLS = frozenset("input select textarea button label option fieldset legend".split())
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars menu nav navbar navigation breadcrumb breadcrumbs header footer masthead notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond pagination pager toolbar widget widgets skip".split()
)
# words that may stand beside such a name in one hyphenated token
COMPANIONS = frozenset(
    "site page main global top bottom left right upper lower inner outer primary secondary mobile desktop sticky fixed bar box block area wrap wrapper container section panel region zone list items item link links slot unit text label title heading button buttons icon icons group row col column posts post articles stories content form field thread body id js".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("html body article main section div nav header footer aside form table td th ul ol dl blockquote button details figure".split())

_TOKEN = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>|[^<]++|<", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAME = re.compile(r"[a-zA-Z0-9]+")
_DIGITS = re.compile(r"[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
FORM_WORDS = 20  # words a control from which a form is text
DEEP = 32  # such elements within each other, after which all of them are lifted at once
LEAST_WORDS = 20  # of an element that is kept though its name is one of boilerplate


@dataclass
class Element:
    tag: str
    parent: int  # place in the list of elements, or -1
    container: str  # tag and classes of the innermost block or classed element, as weights know it
    suspect: bool  # boilerplate by tag, name or role
    firm: bool  # by tag: stays boilerplate whatever it holds
    head: bool  # a header, whose heading may be an article's title
    words: int = 0  # of the whole element, links not counted
    controls: int = 0
    dropped: bool = False
    content: int = -1  # the outermost marked element it lies in


@dataclass
class Token:
    kind: str  # "w": text, "<": start or end tag
    key: str  # the container's key, or the tag's name
    element: int = -1
    text: str = ""
    n: int = 0  # words
    dropped: bool = False
    block: bool = False  # a tag that ends a block
    content: int = -1


def _boilerplate(token: str) -> bool:
    """Whether a class or id token names boilerplate: alone, or together with nothing but companions and numbers."""
    if token.lower() in DROPPED_NAMES:
        return True
    pieces = [_DIGITS.sub("", p).lower() for p in _NAME.findall(_CAMEL.sub("-", token))]
    return len(pieces) > 1 and any(p in DROPPED_NAMES for p in pieces) and all(not p or p in DROPPED_NAMES or p in COMPANIONS for p in pieces)


def _classes(attrs: str) -> tuple[list[str], bool, bool]:
    """Names in class and id, whether they or the role mark boilerplate, and whether only as a header."""
    names, bad, head = [], False, False
    if "=" not in attrs:
        return names, bool(re.search(r"(?:^|\s)hidden(?:\s|$)", attrs)), False
    for k, a, b, c in _ATTR.findall(attrs):
        k, v = k.lower(), a or b or c
        if k in ("class", "id"):
            own = v.split()
            names += sorted(x.lower() for x in own)
            marks = [x for x in own if _boilerplate(x)]
            bad |= bool(marks)
            head |= any("header" in x.lower() for x in marks)
        elif k == "role":
            bad |= v.lower() in DROPPED_ROLES
        elif k == "aria-hidden":
            bad |= v.lower() == "true"
        elif k == "hidden":
            bad = True
    return names, bad, head


def parse(page: str) -> tuple[list[Token], list[Element]]:
    """Text and tag tokens in page order, and the elements. Unclosed and stray tags are taken as browsers mostly do; raw elements' text is dropped."""
    out: list[Token] = []
    elements: list[Element] = []
    stack: list[int] = []
    pos, end = 0, len(page)
    low = None
    match, last = _TOKEN.match, page.rfind(">")

    def word(text):
        top = stack[-1] if stack else -1
        out.append(Token("w", elements[top].container if stack else "", top, text, len(text.split())))

    def mark(tag, text="", block=False):
        out.append(Token("<", tag, stack[-1] if stack else -1, text, block=block))

    while pos < end:
        if pos > last and not page.startswith("<!--", pos):  # no tag ends here any more
            word(page[pos:])
            break
        m = match(page, pos)
        pos = m.end()
        tag = m[2]
        if tag is None:
            if m[0][0] != "<" or len(m[0]) == 1:  # else a comment, doctype or processing instruction
                word(m[0])
            continue
        tag = tag.lower()
        if m[1]:
            if tag in ("br", "p") and not any(elements[e].tag == tag for e in stack):
                continue
            for i in range(len(stack) - 1, -1, -1):
                own = elements[stack[i]].tag
                if own == tag:
                    del stack[i:]
                    mark(tag, block=tag in BLOCK)
                    break
                if tag not in BLOCK and own in SCOPE:
                    break
            continue
        if tag in CONTROLS and stack:
            elements[stack[-1]].controls += 1
        if tag in VOID:
            mark(tag, " " if tag == "br" else "", tag == "hr")
            continue
        closing = CLOSES.get(tag) or ({"p"} if tag in BLOCK else None)
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                own = elements[stack[i]].tag
                if own in closing:
                    del stack[i:]
                    break
                if own in SCOPE:
                    break
        if tag in RAW:
            low = low if low is not None else page.lower()
            at = low.find("</" + tag, pos)
            mark(tag)
            if at < 0:
                if tag in ("script", "style", "xmp"):
                    pos = end
                continue
            close = page.find(">", at)
            pos = end if close < 0 else close + 1
            continue
        names, bad, head = _classes(m[3])
        parent = stack[-1] if stack else -1
        key = tag + "".join("." + n for n in names)
        container = key if tag in BLOCK or names else (elements[parent].container if stack else "")
        bad &= tag not in ("html", "body", "main")
        elements.append(Element(tag, parent, container, bad or tag in DROPPED, tag in DROPPED, tag == "header" or head))
        stack.append(len(elements) - 1)
        mark(tag, block=tag in BLOCK)
        if page[m.end() - 2 : m.end()] == "/>" and tag not in BLOCK:
            stack.pop()
    return out, elements


def _count(tokens: list[Token], elements: list[Element]) -> int:
    """Sums words outside links and form controls up the tree; returns the page's words outside links."""
    linked = [False] * len(elements)
    for i, e in enumerate(elements):
        linked[i] = e.tag == "a" or (e.parent >= 0 and linked[e.parent])
    total = 0
    for t in tokens:
        if t.n and not (t.element >= 0 and linked[t.element]):
            total += t.n
            if t.element >= 0:
                elements[t.element].words += t.n
    for e in reversed(elements):  # children come after their parents
        if e.parent >= 0:
            elements[e.parent].words += e.words
            elements[e.parent].controls += e.controls
    return total


def _drop(elements: list[Element]) -> None:
    """Boilerplate is what is suspect and all within, but for the heading in a marked element's own header; marked elements are numbered."""
    marked = 0
    for e in elements:
        up = elements[e.parent] if e.parent >= 0 else None
        e.dropped = e.suspect or bool(up and up.dropped)
        e.content = up.content if up else -1
        if e.tag in CONTENT and not e.dropped and e.content < 0:
            e.content, marked = marked, marked + 1
        if e.tag in HEADINGS and e.content >= 0 and e.dropped and not e.suspect:
            above, suspects = up, []
            while above:
                suspects += [above] if above.suspect else []
                above = elements[above.parent] if above.parent >= 0 else None
            e.dropped = not (len(suspects) == 1 and suspects[0].head)


def tokenize(page: str) -> list[Token]:
    """The tokens of a page, with their boilerplate marks and marked elements.

    A form is boilerplate where it holds few words for its controls.  Where what is named
    boilerplate leaves less than a tenth of the page's words, links not counted, the
    outermost such element that holds more than half of them is none; tags like nav or
    footer always are.
    """
    tokens, elements = parse(page)
    total = _count(tokens, elements)
    for e in elements:
        if e.tag == "form":
            e.suspect |= e.words < FORM_WORDS * (e.controls + 1)
    for rounds in itertools.count():
        _drop(elements)
        for t in tokens:
            e = elements[t.element] if t.element >= 0 else None
            t.dropped, t.content = bool(e and e.dropped) or (t.kind == "<" and t.key in RAW), e.content if e else -1
        # words of the outermost boilerplate elements, and of the headings spared in them
        outer = [e for e in elements if e.suspect and e.dropped and not (e.parent >= 0 and elements[e.parent].dropped)]
        left = total - sum(e.words for e in outer) + sum(e.words for e in elements if not e.dropped and e.parent >= 0 and elements[e.parent].dropped)
        lift = [e for e in outer if not e.firm and 2 * e.words > total and e.words >= LEAST_WORDS]
        if 10 * left >= total or not lift:
            return tokens
        for e in elements if rounds > DEEP else lift[:1]:
            e.suspect &= e.firm or 2 * e.words <= total


@dataclass
class Weights:
    """Odds by container and by tag; containers never seen count as content."""

    word: dict[str, float] = field(default_factory=dict)
    tag: dict[str, float] = field(default_factory=dict)

    def of(self, t: Token) -> float:
        if t.kind == "<":
            return -self.tag.get(t.key, 0.2)
        if t.dropped:
            return -0.5 * t.n
        return self.word.get(t.key, 1.0) * t.n


def learn(pages: list[str]) -> Weights:
    """Weights from pages with marked content; the rest of the pages teach nothing."""
    words, tags = [Counter(), Counter()], [Counter(), Counter()]
    for page in pages:
        tokens = tokenize(page)
        if not any(t.content >= 0 and t.n for t in tokens):
            continue
        for t in tokens:
            inside = t.content >= 0 and not t.dropped
            if t.kind == "<":
                tags[inside][t.key] += 1
            elif t.n:
                words[inside][t.key] += t.n
    odds = lambda c, k: math.log((c[1][k] + 1) / (c[0][k] + 1))
    w = {k: max(-3.0, min(3.0, odds(words, k))) for k in words[0] | words[1]}
    t = {k: max(0.1, min(3.0, -odds(tags, k))) for k in tags[0] | tags[1]}
    return Weights({k: v if abs(v) > 0.1 else 0.1 for k, v in w.items()}, t)


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """The first contiguous stretch (start, end) with the largest positive sum; (0, 0) if none is positive."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, at = total, (start, i + 1)
    return at


def chosen(tokens: list[Token], weights: Weights) -> list[bool]:
    """Marks of the tokens of the main text: the best stretch, widened to whole blocks, and, if it touches a marked element, all marked elements."""
    lo, hi = best_stretch([weights.of(t) for t in tokens])
    marked = any(t.kind == "w" and t.n and not t.dropped and t.content >= 0 for t in tokens[lo:hi])
    if hi > lo:  # whole blocks
        while lo > 0 and not tokens[lo].block and not tokens[lo - 1].block and tokens[lo - 1].content < 0:
            lo -= 1
        while hi < len(tokens) and not tokens[hi - 1].block and not tokens[hi].block and tokens[hi].content < 0:
            hi += 1
    return [lo <= i < hi or (marked and t.content >= 0) for i, t in enumerate(tokens)]


def extract(page: str | None, weights: Weights) -> tuple[str, tuple[int, int]]:
    """The main text (blocks joined by newlines, white space in them as one space) and the span of the tokens it came from."""
    tokens = tokenize(page or "")
    use = chosen(tokens, weights)
    blocks, parts = [], []

    def close():
        if parts:
            blocks.append(" ".join("".join(parts).split()))
            parts.clear()

    gap = False
    for t, own in zip(tokens, use, strict=True):
        if not own:
            gap = True
            continue
        if gap:  # what is left out between two pieces ends a block
            close()
            gap = False
        if t.kind == "w":
            if not t.dropped:
                parts.append(html.unescape(t.text))
        elif t.block:
            close()
        elif t.text:
            parts.append(t.text)
    close()
    return "\n".join(b for b in blocks if b), (use.index(True), len(use) - use[::-1].index(True)) if any(use) else (0, 0)


def fit(pages: DataFrame, page: str = "html", sample: int = 300, max_chars: int = 100_000) -> Weights:
    """Weights from at most ``sample`` labelled pages, chosen by hash among those of at most ``max_chars``."""
    marked = pages.select(F.col(page).alias("html")).where((F.length("html") <= max_chars) & F.col("html").rlike(r"(?i)<(article|main)[\s>]"))
    # hashes first, so that no more pages move than are learned from
    hashed = marked.select(F.xxhash64("html").alias("h"), "html")
    some = lowest(hashed.select("h").distinct(), F.col("h"), sample)
    rows = hashed.join(F.broadcast(some), "h").groupBy("h").agg(F.min("html").alias("html")).orderBy("h").collect()
    return learn([r["html"] for r in rows])


def main_text(pages: DataFrame, weights: Weights | None = None, page: str = "html") -> DataFrame:
    """The pages' columns but ``page``, with ``text`` and ``n_chars`` (code points; 0 and empty if there is no content).

    A null page is empty. Columns named text or n_chars are replaced. Repeated rows each get a row.
    """
    weights = weights or fit(pages, page)
    keep = [c for c in pages.columns if c not in (page, "text", "n_chars")]
    whole = unused("page", keep)
    src = pages.select(*keep, F.col(page).alias(whole))
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = shared.value
        for b in batches:
            texts = [extract(p.as_py(), w)[0] for p in b.column(whole)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != whole] + ["text string", "n_chars bigint"])
    return src.mapInArrow(run, fields)
