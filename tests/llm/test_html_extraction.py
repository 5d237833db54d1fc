import re
from html import unescape

import pytest

from logtide.llm import html_extraction as H

from .conftest import SMALL

TREE = H.train()
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="with-sidebar"><header><h1>Site</h1>
<p>A long welcome line that says very many things about this site so that it looks like a paragraph.</p></header>
<nav><a href=x>Home</a></nav><form><label>Search everything on this site</label><button>Go</button></form>
<div class="cookie-notice">We use cookies for a good many long reasons which take twenty words or more to set out here.</div>
<main><article><header><h1>Title &amp; more</h1></header><!-- <p>hidden</p> --><p>First&nbsp;para   with <b>bold</b>text.</p>
<p>Short.<div class="ad">Buy now</div><ul><li>One<li>Two</ul><p>Last<br>line &lt;tag&gt; &#233;</p>
<section class="comments"><article><p>I liked this very much, thank you for all the work you put into it.</p></article></section>
</article></main><aside class=sidebar><p>Related</p></aside><div id="comments"><p>first!</p></div>
<footer>&copy; 2024</footer><script>if (a<b) { "<p>x</p></article>" }</script></body></html>"""


def test_article_without_the_rest():
    assert H.main_text(PAGE, TREE) == ("Title & more\nFirst para with boldtext.\nShort.\nOne\nTwo\nLast line <tag> é")


def test_pages_without_landmarks():
    text = "many words stand in this paragraph " * 8
    page = (f"<div><a href=a>Home</a> <a href=b>News</a></div><h1>Big story</h1><p>{text}</p><p>Short one.</p><p>{text}</p>"
            "<div><a href=c>More</a></div>")
    got = H.main_text(page, TREE).split("\n")
    assert got == ["Big story", text.strip(), "Short one.", text.strip()]
    wrapped = H.main_text(f"<form id=page>{page.replace('<h1>', '<article><h1>')}</article></form>", TREE)
    assert wrapped.split("\n")[:4] == got


def test_names_that_only_describe_the_page():
    page = ('<div class="wrap has-sidebar"><article class="post header-large"><h1>Title</h1><p class="byline">By Ann</p>'
            '<p>One.</p></article><div class="footer-links"><p>x</p></div><article class="teaser"><p>y</p></article></div>')
    assert H.main_text(page, TREE) == "Title\nBy Ann\nOne."
    assert H.main_text('<div id="content"><p>a</p><div class="share-buttons">s</div></div><p>b</p>', TREE) == "a"


@pytest.mark.parametrize("html", [
    None, "", " \n", "<", "<p", "</p></p>", "<!-- open", "<script>open", "<article>", "plain & text", "<p>a<p>b" * 3,
    "<a href='x\">" * 50, "&#xZZ; &bogus; &amp", "<article>" + "<div>" * 5000 + "x", "<li>" * 2000, "<b>" * 3000])
def test_broken_markup_ends(html):
    assert isinstance(H.main_text(html, TREE), str)


def test_defined_results(spark):
    long = "<article>" + "<p>word word</p>" * 50_000 + "</article>"
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", long)]
    df = spark.createDataFrame([(*r, "t", 1, "h") for r in rows],
                               "page_id long, url string, html string, text string, n_chars int, key_0 string")
    got = H.extract(df).collect()
    assert [(r.page_id, r.url) for r in got] == [r[:2] for r in rows]
    assert [r.text for r in got][2:4] == ["", ""] and all(r.n_chars == len(r.text) for r in got)
    assert got[4].text.count("\n") == 49_999
    assert H.extract(df.limit(0)).count() == 0


def test_given_pages_whole_articles(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r.page_id: r.text for r in H.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        blocks = [" ".join(unescape(re.sub("<[^>]+>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_tree_learns_its_table_and_bounds():
    assert sum(H.decide(TREE, r[:-1]) == r[-1] for r in H.LABELLED) >= 0.97 * len(H.LABELLED)
    with pytest.raises(ValueError):
        H.train(())
    with pytest.raises(ValueError):
        H.train(((0,) * 10,) * 201)
    stump = H.grow([(1, 0), (2, 0), (3, 1), (4, 1)])
    assert (stump.feature, stump.limit, stump.low.label, stump.high.label) == (0, 2.5, 0, 1)
