import itertools
import random

import pytest
from pulsegrid.llm import html_mss as H

SF = "/root/testdata/sf0.01"
W = H.Weights({"li": -3.0, "footer": -3.0, "p": 3.0, "h1": 3.0}, {"nav": 3.0, "p": 0.1, "article": 0.1})


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("plain text", "plain text"), ("<script>a</script>", ""), ("<p>unclosed", "unclosed"),
        ("<nav><ul><li>Menu</ul></nav><article><h1>T &amp; t</h1><p>a\n b<br>c<p>d&nbsp;e</article><footer>f f f f f f f f f</footer>", "T & t\na b c\nd e"),
        ("<article><p>a</p><aside>no</aside><form>no <p>no</form><div class='share-bar'>no</div><p>b</p></article>", "a\nb"),
        ("<body class=has-sidebar><header>no</header><main><header><h1>Title</h1>by x</header><p>text here</main><section id=comments><p>many words of a reader's comment that go on and on", "Title\ntext here"),
        ("<p>keep &lt;this&gt; <b>bo</b>ld</p><!-- <p>no</p> --><style>p{}</style>", "keep <this> bold"),
        ('<div role="navigation">one two three</div><div><p>body text</div><div hidden>x</div>', "body text"),
        ("a < b & c > d", "a < b & c > d"), ("<title>no</title><p>yes</p>", "yes"), ("<article><script>var t='</p>';</script><p>x</p>", "x"),
    ],
)
def test_pages(page, want):
    assert H.extract(page, W)[0] == want


def test_linear_scan_equals_all_stretches():
    r = random.Random(3)
    for _ in range(200):
        s = [r.choice([-3.0, -1.0, 0.5, 2.0]) for _ in range(r.randrange(12))]
        lo, hi = H.best_stretch(s)
        best = max([0.0] + [sum(s[i:j]) for i, j in itertools.combinations(range(len(s) + 1), 2)])
        assert sum(s[lo:hi]) == best


def test_whole_pages_against_source_documents(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    docs = {"\n".join(" ".join(x.split()) for x in r.text.split("\n") if x.split()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = H.main_text(pages).collect()
    assert len(got) == pages.count() and all(r.n_chars == len(r.text) for r in got)
    assert all((r.text.split("\n", 1) + [""])[1] in docs for r in got)


def test_table_edges(spark):
    df = spark.createDataFrame([(1, None, "u", "x"), (1, "<p>a", None, "x"), (None, "", None, "x")], "page_id long, html string, url string, text string")
    assert sorted((r.text, r.n_chars) for r in H.main_text(df).collect()) == [("", 0), ("", 0), ("a", 1)]
    assert H.main_text(df.limit(0)).count() == 0


def test_malformed_markup_is_linear():
    for page in ("<a " * 50_000, "<p>" * 20_000 + "x", "&" * 100_000, "<!--" + "x" * 200_000, '<a b="' * 20_000, "<div>" * 3000 + "y" + "</div>" * 3000):
        H.extract(page, W)
