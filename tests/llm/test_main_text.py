"""Main text of pages against texts that are known."""

from __future__ import annotations

import html
import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lithospark.llm.main_text import blocks_of, extract, labelled, main_text, op11_html_extraction, page_blocks

FOLDER = "/root/testdata/sf0.01"

EN = "The house by the river was old, and the people of the town said that it had been there for as long as they could remember."
DE = "Das Haus an dem Fluss war alt, und die Leute in der Stadt sagten, dass es schon da war, als sie noch klein waren."
FR = "La maison au bord de la rivière était vieille, et les gens de la ville disaient que c'était la plus belle du pays."
ES = "La casa al lado del río era vieja, y los vecinos del pueblo decían que estaba allí desde que ellos lo recordaban."

MENU = '<ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li><li><a href="/c">News &amp; more</a></li></ul>'
BESIDE = {
    "nav": f"<nav>{MENU}</nav>",
    "menu by class": f'<div class="main-menu">{MENU}</div>',
    "header": f"<header><p>{EN}</p></header>",
    "footer": f"<footer>{EN} &copy; 2024</footer>",
    "aside": f"<aside><h3>More</h3><p>{EN}</p></aside>",
    "sidebar": f'<div id="sidebar-left"><p>{EN}</p></div>',
    "cookies": f'<div class="cookieNotice">We use cookies. {EN}<button>Accept all</button></div>',
    "notice": f'<section class="site-notice"><p>{EN}</p></section>',
    "advert": f'<div class="ad">{EN}</div>',
    "sponsored": f'<p class="sponsored_post">{EN}</p>',
    "form": f"<form action=x><p>{EN}</p><label>Name</label><input name=n><textarea>{EN}</textarea><select><option>One</option></select></form>",
    "script": f'<script>var a = "</p><p>{EN}";</script>',
    "style": "<style>p > a { margin: 0 } /* <p> */</style>",
    "comment": f"<!-- <p>{EN}</p> -->",
    "hidden": f'<div hidden>{EN}</div><div style="display: none">{EN}</div>',
    "role": f'<div role="complementary">{EN}</div>',
    "dialog": f"<dialog open>{EN}</dialog>",
    "readers": f'<div id="comments"><div class="comment-body"><p>{EN}</p></div><article class="comment">{EN}</article></div>',
    "readers by heading": f"<section><h3>12 Comments</h3><div><p>{EN}</p></div></section>",
    "readers in words": f'<div class="reader-discussion">{EN}</div><ol id="kommentare"><li>{EN}</li></ol>',
    "parts of the side": f'<div class="sidebar-content"><p>{EN}</p></div><div class="footer-content">{EN}</div>',
    "cards": f'<section class="related-articles"><article><h3>Other</h3><p>{EN}</p></article></section>',
    "numbered adverts": f'<div id="ad_slot2"><p>{EN}</p></div><ins class="adsbygoogle">{EN}</ins><div class="advertContainer">{EN}</div>',
    "share": '<div class="social-share"><a href=x>Tweet</a> <a href=y>Share</a></div>',
    "links": '<p><a href="/1">Ten things that you did not know about the house</a> <a href="/2">And ten more of them for you</a></p>',
    "noscript": f"<noscript><p>{EN}</p></noscript>",
    "svg": "<svg><text>drawn</text></svg>",
}


@pytest.mark.parametrize("holder", ["<article>{}</article>", "<main>{}</main>", '<div class="post-content">{}</div>', "{}"])
@pytest.mark.parametrize("text", [EN, DE, FR, ES])
def test_what_stands_beside_goes(holder, text):
    body = f"<h1>A title</h1><p>{text}</p><h2>Next</h2><p>Short.</p><ul><li>one</li><li>two, and {text}</li></ul><p>{text}</p>"
    want = f"A title {text} Next Short. one two, and {text} {text}"
    for name, beside in BESIDE.items():
        for page in (beside + holder.format(body), holder.format(body) + beside, beside + holder.format(body) + beside):
            assert main_text(f"<!DOCTYPE html><html><head><title>T</title></head><body>{page}</body></html>") == want, name
    everything = "".join(BESIDE.values())
    assert main_text(f"<html><body>{everything}{holder.format(body)}{everything}</body></html>") == want


@pytest.mark.parametrize("name", [k for k in BESIDE if k not in ("header", "links")])
def test_what_stands_inside_an_article_goes(name):
    assert main_text(f"<article><h1>A title</h1><p>{EN}</p>{BESIDE[name]}<p>End.</p></article>") == f"A title {EN} End."


def test_an_article_is_whole():
    text = f"<header><h1>Title</h1><p>By A. B.</p></header><p>{EN}</p><pre>x = 1\n  y = 2</pre><table><tr><td>zzz<td>yyy<tr><td>xxx qqq www</table><p>zzzz xxxx wwww qqqq kkkk vvvv bbbb nnnn mmmm pppp llll jjjj<p>All rights reserved.<blockquote>&ldquo;So.&rdquo;</blockquote>"
    want = f"Title By A. B. {EN} x = 1 y = 2 zzz yyy xxx qqq www zzzz xxxx wwww qqqq kkkk vvvv bbbb nnnn mmmm pppp llll jjjj All rights reserved. \u201cSo.\u201d"
    assert main_text(f"<body><p>{DE}</p><article>{text}</article></body>") == want


def test_names_of_classes_do_not_hide_an_article():
    for around in ("no-comments has-sidebar", "sidebar-layout", "page-header-wrapper", "with-ads", "loading adaptive shadow", "content side", "entry-header-none", "headline shadows"):
        assert main_text(f'<body class="single comment-page"><div class="{around}"><article><p>{EN}</p></article></div></body>') == EN, around
    assert main_text(f'<div class="widget"><p>{EN}</p></div>') == EN
    assert main_text(f"<form><div><p>{EN}</p></div></form>") == EN
    assert main_text('<div class="ad">Buy.</div>') == ""


def test_white_space_and_references():
    assert main_text("<p> a\n\t b&nbsp;&nbsp;c<br>d<b>e</b>f &amp;amp; &lt;p&gt; &#233;&#x1F600;&eacute &unknown; &#0;&#99999999999;&#xD800; A&B</p>") == (
        "a b c def &amp; <p> \u00e9\U0001f600\u00e9 &unknown; \ufffd\ufffd\ufffd A&B"
    )
    assert main_text("one<div>two</div>three") == "one two three"
    assert main_text('<p title="a > b" class=x data-x=\'">\'>in</p><p title="open>out</p>') == "in out"


@pytest.mark.parametrize(
    "page",
    ["<" * 200_000, "<!--" * 80_000, "<a " * 80_000, "<![CDATA[" * 40_000, "<div>" * 50_000 + "</p>" * 50_000, "&" * 200_000, '<a x="' * 50_000 + ">", "<a x='=\"" * 30_000 + ">" * 9,
     "</" * 100_000, "<script>" * 50_000, "<style>" + "</" * 100_000, "<p>word " * 40_000, "<a href=x>" * 40_000, "&#" + "1" * 10_000 + ";", "&#" + "0" * 10_000 + "65;", "\x00<p\x00>\ud7ff"],
)
def test_broken_and_long_pages_end(page):
    start = time.perf_counter()
    main_text(page)
    main_text(f"<article><p>{EN}</p>{page}")
    assert time.perf_counter() - start < 15


def test_random_markup_keeps_all_words():
    pick = random.Random(3)
    for _ in range(200):
        words, made = [], []
        for k in range(60):
            tag = pick.choice(["p", "b", "div", "li", "ul", "td", "tr", "h2", "i", "span", "section", "br"])
            made.append(pick.choice([f"<{tag}>", f"</{tag}>", f"<{tag} class='x{k}'>", " "]))
            words.append(f"w{k}")
            made.append(f" w{k} ")
        assert main_text("<article>" + "".join(made)).split() == words


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_articles_of_the_tables_come_out_whole(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    got = op11_html_extraction(spark, FOLDER)
    assert [f"{c} {kind}" for c, kind in got.dtypes] == ["page_id bigint", "url string", "text string", "n_chars bigint"]
    got = got.collect()
    assert len(got) == len(pages)
    for r in got:
        inside = re.search("<article>(.*?)</article>", pages[r.page_id], re.S).group(1)
        assert r.text == " ".join(html.unescape(re.sub("<[^>]*>", " ", inside)).split()) and r.n_chars == len(r.text)
    # Without the article's own element the menus, adverts and footers still go.
    for page in list(pages.values())[:50]:
        bare = main_text(re.sub("</?article>", "", page))
        for gone in re.findall("<nav>.*?</nav>|<footer>.*?</footer>|<div class=.ad.>.*?</div>", page):
            assert " ".join(html.unescape(re.sub("<[^>]*>", " ", gone)).split()) not in bare


def test_odd_rows(spark):
    page = f"<p>{EN}</p>"
    rows = [(1, None), (2, ""), (None, page), (3, page), (3, page), (4, "no markup"), (5, "<p>" + "the word " * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, html string").select("*", *[F.lit("extra").alias(c) for c in ("text", "n_chars", "url", "tag")]).repartition(2)
    got = extract(pages)
    assert got.columns == ["page_id", "html", "url", "tag", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.text[:9], r.n_chars) for r in got.collect()) == [
        (0, EN[:9], len(EN)), (1, "", 0), (2, "", 0), (3, EN[:9], len(EN)), (3, EN[:9], len(EN)), (4, "no markup", 9), (5, "the word ", 1_799_999)
    ]
    assert extract(pages.where("false")).count() == 0
    labels = page_blocks(pages).where("page_id = 3").collect()
    assert [(r.block, r.tag, r.text, r.main) for r in labels] == [(0, "p", EN, True)] * 2
    assert page_blocks(pages.where("false")).count() == 0


def test_other_languages_by_length(spark):
    text = "\u0414\u043e\u043c \u0441\u0442\u043e\u044f\u043b \u043d\u0430 \u0440\u0435\u043a\u0435 " * 5
    assert main_text(f"<div>{MENU}</div><p>{text}</p>") == text.strip()
    assert [b.text for b, good in zip(blocks_of(f"<p>x</p><p>{EN}</p>"), labelled(blocks_of(f"<p>x</p><p>{EN}</p>")), strict=True) if good] == ["x", EN]
    assert main_text(f"<p>{EN}</p>", frozenset()) == EN
