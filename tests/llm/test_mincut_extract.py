"""Main text: cuts against all labellings, and pages whose article is known."""

import itertools
import random

import pytest

from hitweave.llm import mincut_extract as X


def test_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randrange(1, 8)
        scores = [round(rng.uniform(-3, 3), 2) * (rng.random() > 0.1) for _ in range(n)]
        edges = [(a, b, round(rng.uniform(0.1, 2), 2)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]

        def cost(labels):
            ends = sum(s if s > 0 and not x else -s if s < 0 and x else 0 for s, x in zip(scores, labels))
            return ends + sum(w for a, b, w in edges if labels[a] != labels[b])

        best = min(map(cost, itertools.product([False, True], repeat=n)))
        assert cost(X.minimum_cut(scores, edges)) == pytest.approx(best, abs=1e-6)


PAGE = """<!DOCTYPE html><html><head><title>Title</title><style>p{}</style><script>var t="</p>";</script></head><body class="home">
<header id="masthead"><a href="/">Site</a> <p>The best site of all sites there are, says everyone who knows it.</p></header>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies to make this page better for you and for our many partners. Read on.</p></div>
<article><h1>The &amp; heading</h1><p>First   paragraph, with <b>bold</b> &eacute;t&eacute; and a <a href="x">link</a>.
<p>Second paragraph<br>after a break &lt;here&gt; &#8212; it goes on for some more words.</p><p>Short.</p>
<div class="ad">Buy now! Everything is cheap today, so buy one and get another one.</div>
<p>Third paragraph comes after the advert and says something else.</p>
<form action="/s"><label>Your mail address</label><input name="m"><button>Send</button></form>
<section class="comments"><p>I read this and liked it very much, thank you for writing.</p></section></article>
<aside class="sidebar"><p>Other stories that you may like, chosen for you by our editors.</p></aside>
<!-- <p>commented out</p> --><footer>&copy; 2024 &middot; All rights reserved. Terms and conditions apply.</footer></body></html>"""


def test_article():
    assert X.main_text(PAGE).split("\n") == [
        "The & heading",
        "First paragraph, with bold été and a link.",
        "Second paragraph after a break <here> — it goes on for some more words.",
        "Short.",
        "Third paragraph comes after the advert and says something else.",
    ]


def test_page_without_article_tag():
    body = "".join(f"<p>Paragraph {i} has quite a few words in it, so that it looks like text.</p>" for i in range(8))
    page = f'<div class="menu"><a href=1>Home</a> <a href=2>About</a></div><div>{body}<p>Short one</p>{body}</div><div id="footer">Imprint</div>'
    assert X.main_text(page).count("\n") == 16 and "Short one" in X.main_text(page)


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!--", "<script>x", "</p></div>", "<a href='x", "&am", "<p>" * 3000, "a < b > c"])
def test_odd_pages(page):
    assert isinstance(X.main_text(page), str)


@pytest.mark.parametrize("tag", sorted(X.SILENT))
def test_silent_elements(tag):
    """With an end tag, nested, with an end tag of another kind between, or without one: only the text inside goes."""
    words = ["The first paragraph of the page.", "The second paragraph of the page."]
    for inside in (f"<{tag} a='>'>x <i>y</i></{tag}>", f"<{tag}>x<{tag}>y</{tag}>z</{tag}>", f"<{tag}>x</b>y</{tag} >", f"<{tag}>x"):
        page = f"<article><p>{words[0]}{inside}</p><p>{words[1]}</p></article>"
        assert X.main_text(page).split("\n") == words, inside
    within = f"<article><div><{tag}>unseen</div><p>{words[0]}</p><p>{words[1]}</p></article>"
    assert X.main_text(within).split("\n") == words


def test_button_ends_where_a_block_begins():
    assert X.main_text("<article><button>Send<p>The paragraph that follows it.</p></article>") == "The paragraph that follows it."


def test_head_without_end_tag():
    page = "<html><head><title>t</title><style>p{}</style><body><article><p>The article, which is short.</p></article>"
    assert X.main_text(page) == "The article, which is short."
    assert X.main_text(page.replace("<body>", "")) == "The article, which is short."


def test_many_open_elements_take_linear_time():
    page = "<article>" + "<button>x<svg>y" * 20_000 + "<p>The end of a long page.</p></article>"
    assert X.main_text(page) == "The end of a long page."


def test_cut_off_page():
    page = PAGE[: PAGE.index("goes on") + 4] + '<a href="/Asc'
    assert X.main_text(page).split("\n")[-1] == "Second paragraph after a break <here> — it goes"


def test_long_page():
    page = "<article>" + "".join(f"<p>Text number {i} of a very long page.</p>" for i in range(20_000)) + "</article>"
    assert X.main_text(page).count("\n") == 19_999


def test_rows(spark):
    pages = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<article><p>Just this.</article>")]
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, _main string")
    got = {(r.page_id, r.url): r._main for r in X.extract(frame).collect()}
    assert got[2, None] == got[None, "v"] == "" and got[3, "w"] == "Just this." and got[1, "u"] == X.main_text(PAGE)
    assert X.extract(frame).count() == 5 and X.extract(frame.limit(0)).count() == 0
