"""Operator 11: planted articles in several layouts, broken markup, odd tables, and a plain reading of the given pages."""

import html
import random
import re

import pytest

from pitspark.llm import articles

TITLE = "The river rose again"
BODY = [
    "Water stood in the lower streets by noon, and the old bridge was closed to carts, horses and people.",
    "Nobody was hurt; the mill, however, lost its wheel. The miller said he had seen worse in his youth.",
    "By evening the rain had stopped.",
    "Engineers will look at the bridge on Monday, and the council meets the day after to hear what they found.",
]
TEXT = " ".join([TITLE, *BODY])
P = "".join(f"<p>{b}</p>" for b in BODY)
LINKS = "<ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in "home news sport weather".split()) + "</ul>"
COMMENTS = "".join(f"<div class='comment'><p>{who}</p><p>I was there, and it was worse than that; much worse, in fact, than anybody says. Thanks for writing it up!</p></div>" for who in "anna bert carla".split())

LAYOUTS = {
    "article": f"<nav>{LINKS}</nav><div class=ad>Buy now, pay later!</div><article><h1>{TITLE}</h1>{P}</article><footer>&copy; 2020 Paper.</footer>",
    "names": f"<div id=header><h1>The Daily</h1></div><div id='main-menu'>{LINKS}</div><div class=content><h2>{TITLE}</h2>{P}</div><div class='sidebar right'><p>Read this too, please.</p></div>"
    f"<div id=comments>{COMMENTS}</div><div class='cookie-notice'><p>We use cookies, as everybody does. Do you agree?</p></div><div id=footer><p>All rights reserved, 2020.</p></div>",
    "no names": f"<div>{LINKS}</div><div><div><h1>{TITLE}</h1>{P}</div></div><div><span>Printed in town</span></div>",
    "title above": f"<div><h1>{TITLE}</h1></div><div>{P}</div><div>{LINKS}</div>",
    "comments inside": f"<main><article><header><h1>{TITLE}</h1></header>{P}<section id=comments><h2>Readers say</h2><article><p>Well, I never, said I; not once.</p></article>{COMMENTS}</section></article></main>",
    "form around all": f"<form id=aspnet><div class=top-nav>{LINKS}</div><div class=story><h1>{TITLE}</h1>{P}</div><div class=newsletter-signup><p>Sign up for our letters, every day.</p><form><input name=q><button>Send</button></form></div></form>",
    "table": f"<table><tr><td width=100>{LINKS}</td><td><h1>{TITLE}</h1>{P}</td></tr></table><p><a href=/imprint>Imprint</a></p>",
    "unclosed": f"<nav>{LINKS}</nav><article><h1>{TITLE}</h1><p><b>{BODY[0]}<br><p>{BODY[1]}<p><i>{BODY[2]}<p>{BODY[3]}",
    "raw text": f"<script>document.write('</p><article><p>no</p>');</script><style>p > a {{}}</style><article><h1>{TITLE}</h1><!-- <p>no</p> --><p title='a > b'>{P[3:]}<noscript><p>no</p></noscript></article><script>open",
    "with main": f"<header><h1>Site</h1>{LINKS}</header><main class='with-sidebar'><h1>{TITLE}</h1>{P}<aside><p>More, much more, of the same, here.</p></aside></main><aside><p>And so on, and so on.</p></aside>",
    "hidden": f"<article><h1>{TITLE}</h1><p hidden>no, not this.</p><p style='display: none'>nor this.</p>{P}<span class='share-buttons'>Share</span></article>",
    "components": f"<x-page><cookie-banner><p>Yes, cookies, many of them, again.</p></cookie-banner><div role=navigation>{LINKS}</div><div role=main><h1>{TITLE}</h1>{P}</div></x-page>",
    "two articles": f"<article><h1>{TITLE}</h1>{P}</article><div class=related><article><h3>Other news</h3><p>Short, but with commas, and so on.</p></article></div>",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    assert articles.main_text(f"<!DOCTYPE html><html><head><title>no</title></head><body>{LAYOUTS[name]}</body></html>") == TEXT


def test_everything_inside_an_article_stays():
    inside = "<h1>A</h1><p>B</p><ul><li>c</li><li>d</li></ul><table><tr><td>e</td><td>f</td></tr></table><blockquote><p>g</p></blockquote><figure><figcaption>h</figcaption></figure><pre>i  j</pre><p>k <a href=x>l</a></p>"
    assert articles.main_text(f"<nav>{LINKS}</nav><article>{inside}</article><footer>{P}</footer>") == "A B c d e f g h i j k l"
    mixed = f"<div><h2>{TITLE}</h2>{P}<ul><li>one</li><li>two</li></ul><h3>End</h3></div><div><i>ad</i></div>"
    assert articles.main_text(mixed) == TEXT + " one two End"


def test_inline_text_and_references():
    assert articles.main_text("<p>a<b>b</b>c &amp; &lt;d&gt; &#233;&nbsp;\n\t e<br>f &notaref; 1 < 2</p>") == "abc & <d> é e f ¬aref; 1 < 2"
    assert articles.main_text("plain text,\nno markup") == "plain text, no markup"


@pytest.mark.parametrize("page", ["", "   ", "<", "<a", "<!--", "<p title='", "</p></p>", "<script>", "<b><i></b></i>", "<td>x", "&#0;&#x110000;", "<nav>x</nav>", "<![CDATA[x]]>", "<p>" * 3000])
def test_broken_markup_does_not_fail(page):
    assert isinstance(articles.main_text(page), str)


def test_deep_and_long_pages():
    deep = "<div>" * 5000 + "<p>deep, very deep, text.</p>" + "</div>" * 5000
    assert articles.main_text(deep) == "deep, very deep, text."
    long = "word, " * 200_000
    assert articles.main_text(f"<article><p>{long}</p></article>") == long.strip()
    many = "".join(f"<p>paragraph {i}, one of many.</p>" for i in range(20_000))
    assert articles.main_text(f"<article>{many}</article>").endswith("paragraph 19999, one of many.")


def test_path_scores_prefer_prose():
    paths = [("body", "ul", "li")] * 4 + [("body", "div", "p")] * 4
    score, which = articles.path_scores(paths, ["home", "news", "sport", "more"] + BODY, [4, 4, 5, 4, 0, 0, 0, 0])
    assert len(set(which)) == 2 and score[4:].min() > 5 * score[:3].max()


def plain(page):
    """The article of the given layout, by its element alone."""
    inside = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.DOTALL)[1]
    parts = (" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:h1|p)>|<br>", inside))
    return " ".join(x for x in parts if x)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: (r.url, plain(r.html)) for r in pages.collect()}
    rows = articles.extract(pages).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert (r.url, r.text, r.n_chars) == (*want[r.page_id], len(want[r.page_id][1]))


def test_random_markup_keeps_words():
    rng = random.Random(3)
    for _ in range(200):
        words = [f"w{i}" for i in range(rng.randint(1, 30))]
        page = "".join(w + rng.choice([" ", "<br>", "</p><p>", " <b>", "</b> ", " <i class=x>", "</i> ", "<h2>", "</h2>"]) for w in words)
        assert articles.main_text(f"<article>{page}</article>").split() == words


def test_odd_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, "u", None, "clash", "clash"), (1, "u", None, "clash", "clash"), (None, None, "", "c", "c"), (2, None, LAYOUTS["article"], None, None)]
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in articles.extract(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, "u", "", 0), (1, "u", "", 0), (None, None, "", 0), (2, None, TEXT, len(TEXT))], key=str)
    assert articles.extract(spark.createDataFrame([], schema)).count() == 0
