import random

import pytest
from pulsegrid.llm import html_mss as H

W = H.Weights({"li": -3.0, "p": 3.0, "h1": 3.0}, {"nav": 3.0, "p": 0.1, "article": 0.1})


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<nav><li>Menu</nav><article><p>first one here</article><article><p>second</article>", "first one here\nsecond"),
        ("<nav><li>Menu</nav><h1>The headline</h1><article><p>many words of text here</article>", "The headline\nmany words of text here"),
        ("<article><p>text of the page</article><p>and its last lines", "text of the page\nand its last lines"),
        ("<p>some words stand before <b>bold</b></p><main><p>one</main>", "some words stand before bold\none"),
    ],
)
def test_marked_elements_only_widen_the_stretch(page, want):
    assert H.extract(page, W)[0] == want


def test_never_less_than_the_stretch():
    r = random.Random(5)
    for _ in range(300):
        page = "".join(r.choice(["<article>", "</article>", "<main>", "</main>", "<p>", "word ", "two words ", "<nav><li>x</nav>", "<b>b</b> "]) for _ in range(r.randrange(25)))
        tokens = H.tokenize(page)
        lo, hi = H.best_stretch([W.of(t) for t in tokens])
        a, b = H.extract(page, W)[1]
        assert lo == hi or a <= lo and hi <= b


TEXT = "this is the text of the page that a reader came for and it goes on for some more words until the end of it"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<div class="layout has-sidebar"><p>{TEXT}</p><div class="sidebar">one two three</div></div>', TEXT),
        (f'<div class="ad-free reading"><p>{TEXT}</p></div><div class="ad">buy this now</div>', TEXT),
        (f'<form action="/x"><input type=hidden><div><p>{TEXT}</p></div><input><button>Go</button></form>', TEXT),
        (f"<article><p>{TEXT}</p><section id=related-work><p>{TEXT}</p></section><div class=related-posts><p>no no</p></div></article>", f"{TEXT}\n{TEXT}"),
        (f"<article><p>{TEXT}</p></article><nav>{'<li>item ' * 30}</nav><ul>{'<li>other item</li>' * 40}</ul><article><p>second</p></article>", f"{TEXT}\nsecond"),
        (f"<article><p>{TEXT}</p></article><div id=comments>{f'<article class=comment><p>{TEXT}</p></article>' * 5}</div>", TEXT),
        (f"<div class=sidebar id=promo-box><p>{TEXT}</p><div class=comments><p>{TEXT} {TEXT} {TEXT}</p></div></div>", TEXT),
        (f"<div class='cookie-notice'>we use them</div><div class=siteFooter>{TEXT}</div><p>{TEXT}</p>", TEXT),
        ("<header>site name</header><nav>a b c</nav><footer>legal words</footer>", ""),
        (f"<main><div class=header><h1>Title</h1>by x</div><p>{TEXT}</p></main>", f"Title\n{TEXT}"),
        (f"<p>{TEXT}</p><form><label>Name</label><input><label>Mail</label><input><button>Send</button> leave a reply here</form>", TEXT),
    ],
)
def test_names_do_not_cost_the_text(page, want):
    weights = H.Weights({"li": -3.0, "ul": -3.0, "p": 3.0, "h1": 3.0}, {"nav": 3.0, "p": 0.1, "article": 0.1})
    assert H.extract(page, weights)[0] == want


def plain(page, weights):
    """The text by all stretches and letter by letter, from the tokens and their weights."""
    tokens = H.tokenize(page)
    scores = [weights.of(t) for t in tokens]
    n = len(tokens)
    best, lo, hi = max([(0.0, 0, 0)] + [(sum(scores[i:j]), i, j) for i in range(n) for j in range(i + 1, n + 1)], key=lambda x: (round(x[0], 9), -x[2], x[1]))
    use = {i for i in range(lo, hi)}
    edge = lambda t: t.block
    if use:
        i = lo
        while i > 0 and not edge(tokens[i]) and not edge(tokens[i - 1]) and tokens[i - 1].content < 0:
            i -= 1
        j = hi
        while j < n and not edge(tokens[j - 1]) and not edge(tokens[j]) and tokens[j].content < 0:
            j += 1
        if any(tokens[k].content >= 0 and tokens[k].kind == "w" and tokens[k].text.split() and not tokens[k].dropped for k in use):
            use |= {k for k in range(n) if tokens[k].content >= 0}
        use |= set(range(i, j))
    line, lines = "", []
    for k in range(n):
        t = tokens[k]
        if k in use and t.kind == "w" and not t.dropped:
            line += t.text
        elif k in use and t.kind == "<" and not t.block:
            line += t.text
        elif (k in use and t.block) or k not in use:
            lines, line = lines + [line], ""
    return "\n".join(" ".join(x.split()) for x in lines + [line] if x.split())


def test_extract_equals_brute_force():
    r = random.Random(11)
    some = ["<article>", "</article>", "<main>", "</main>", "<p>", "</p>", "word ", "two words ", "<nav><li>x</nav>", "<b>b</b> ", "<br>", "<div class=ad>", "<div>", "</div>", "<li>item", "<form><input>", "</form>", "<a href=x>link</a>", "<h1>head</h1>"]
    for _ in range(400):
        weights = H.Weights({k: r.uniform(-3, 3) for k in ("p", "div", "li", "h1", "main", "article", "")}, {k: r.uniform(0.1, 3) for k in ("nav", "p", "b", "li", "div", "article")})
        page = "".join(r.choice(some) for _ in range(r.randrange(30)))
        assert H.extract(page, weights)[0] == plain(page, weights), page


def test_clashing_columns(spark):
    df = spark.createDataFrame([("<p>a b</p>", 1, 2, "z")], "html string, page int, Page0 int, _html string")
    got = H.main_text(df, W)
    assert got.columns == ["page", "Page0", "_html", "text", "n_chars"] and [tuple(x) for x in got.collect()] == [(1, 2, "z", "a b", 3)]


def test_nested_names_take_little_time():
    page = "<div class=sidebar>" * 5000 + f"<p>{TEXT}</p>"
    assert H.extract(page, W)[0] == TEXT
