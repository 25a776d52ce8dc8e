from __future__ import annotations

import random
import re
import time
from collections import Counter

import pytest

from tallyspark.llm.html_text import extract_text, main_text

ARTICLE = "<h1>A heading</h1><p>First words of it, and <a href='x'>a link</a> too.</p><p>Short.</p><ul><li>One, two.</li></ul>"
TEXT = "A heading\nFirst words of it, and a link too.\nShort.\nOne, two."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title></head><body><nav><a href=1>Home</a></nav><article>{ARTICLE}</article><footer>&copy; me, 2020.</footer></body></html>",
        f"<body><header><p>The site, and a long line about it.</p></header><main>{ARTICLE}</main><aside><p>By the side, some words.</p></aside></body>",
        f"<div id=menu><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div><div class='post-body'>{ARTICLE}</div><div class='comments'><p>Nice one, thank you very much.</p></div>",
        f"<article>{ARTICLE}<form><p>Your name, please.</p></form><div class='share'>Tell all, now.</div><script>var a='</p>';</script><!-- <p>no</p> --></article>",
        f"<div class='cookie-banner'>We use cookies, yes.</div><article>{ARTICLE}<section class=comments><p>First!</p></section></article>",
        f"<article>{ARTICLE}",
        f"<p class='notice'>Closed, for now.</p><article>{ARTICLE}</article></body></html></div></p>",
    ],
)
def test_article_only(page):
    assert main_text(page) == TEXT


@pytest.mark.parametrize(
    "page",
    [
        f"<div id='page' class='has-sidebar'><article>{ARTICLE}</article></div>",
        f"<div id='page' class='sidebar-right'><article>{ARTICLE}</article><div class='sidebar'>Some words, by the side.</div></div>",
        f"<div class='content with-sidebar'>{ARTICLE}</div><div class='footer'>All rights, and so on.</div>",
        f"<div class='sidebar-left'>{ARTICLE}<div class='share'>Tell all, now.</div></div>",
        f"<main><div class='side layout'><article>{ARTICLE}</article></div></main>",
        f"<article>{ARTICLE.replace('<h1>', '<header class=entry-header><h1>').replace('</h1>', '</h1></header>')}</article>",
        f"<div class='post'>{ARTICLE.replace('<h1>', '<header class=entry-header><h1>').replace('</h1>', '</h1></header>')}</div>",
        f"<div class='legal'>{ARTICLE}</div>",
        f"<article>{ARTICLE}</article><div class='related-posts'><article><p>More, of it.</p></article></div>",
        f"<div class='page sidebar'><article>{ARTICLE}</article><div class='related'><article><p>More, of it.</p></article></div></div>",
        f"<article>{ARTICLE}</article><div id='comments'>{'<article><p>I think so too, and more than that.</p></article>' * 9}</div>",
        f"<div class='post'>{ARTICLE}</div><div id='comments'>{'<p>I think so too, and more than that.</p>' * 9}</div>",
        f"<div class='post'>{ARTICLE}</div><div id='footer'><p>{'All rights, and so on. ' * 9}</p></div>",
    ],
)
def test_names_do_not_take_the_article(page):
    assert main_text(page) == TEXT


LONG = "Words of it, and more; all in one line. So it goes on: to the end. " * 5
ITEMS = "<ul><li>An item without any marks in it at all</ul><table><caption>What the cells say</caption><tr><th>Name<td>42</table><pre>x = 1</pre><figure><figcaption>A figure</figcaption></figure>"
KEPT = ["An item without any marks in it at all", "What the cells say", "Name", "42", "x = 1", "A figure"]


@pytest.mark.parametrize(
    "page",
    [
        "<div id=menu><ul><li><a href=1>One</a></ul></div><div class='content'>{}</div><div class='comments'><p>Nice one, thank you very much.</p></div>",
        "<body><ul><li><a href=1>One</a></ul><div class='content'><div>{}</div></div><div class=bottom>Up</div></body>",
        "<table><tr><td class=left><a href=1>One</a></td><td class=text>{}</td></tr></table>",
        "<html><body><div class=top>Site</div>{}<div class=bottom>Up</div></body></html>",
        "{}",
    ],
)
def test_items_cells_and_captions_of_a_container_stay(page):
    assert main_text(page.format(f"<h1>Title</h1>{f'<p>{LONG}</p>' * 3}{ITEMS}<p>{LONG}</p>")).split("\n") == ["Title", *[LONG.strip()] * 3, *KEPT, LONG.strip()]


def test_references_space_and_unclosed():
    assert main_text("<article><p>a&amp;b &lt;c&gt;\n\t d&#233;<br>e <b>f</b>g<p>h</article>") == "a&b <c> dé e fg\nh"
    assert main_text("1 < 2 and 3 > 2") == "1 < 2 and 3 > 2"
    assert main_text("<script>x</script>") == main_text("<nav>a</nav>") == main_text("<<<") .replace("<", "") == ""
    assert main_text("<p>" + "word, " * 50_000) == ("word, " * 50_000).strip()
    assert main_text("<div>" * 3000 + "deep, text.") == "deep, text."


@pytest.mark.parametrize(
    "page",
    [
        f"<form id=aspnetForm><input name=state><div>Site name</div><div class=content>{ARTICLE}</div></form>",
        f"<body><form action=x><div id=page class=has-sidebar><article>{ARTICLE}</article></div><input></form></body>",
        f"<div>Site name</div><form role=form><main>{ARTICLE}</main></form>",
        f"<article>{ARTICLE}</article><form><label>Your name, please.</label><textarea>x</textarea></form>",
        f"<div class=content>{ARTICLE}<form class=search><p>Find, in all of it.</p></form></div>",
    ],
)
def test_a_form_goes_only_if_it_is_one(page):
    text = main_text(page)
    assert text.removeprefix("Site name\n") == TEXT


def test_linked_items_of_a_container_stay():
    items = "<ul><li><a href=1>A linked item of the list</a><li>Another one, not linked<li><a href=2>Third</a></ul>"
    page = f"<div id=menu><a href=0>Home</a></div><div class=content><h1>T</h1>{f'<p>{LONG}</p>' * 3}{items}<p>{LONG}</p></div>"
    assert main_text(page).split("\n") == ["T", *[LONG.strip()] * 3, "A linked item of the list", "Another one, not linked", "Third", LONG.strip()]


def test_hidden_inline_elements_go():
    assert main_text("<article><p>Seen <span hidden>SECRET</span> and <b style='display: none'>S2</b>read<span class='visually-hidden'> too</span></p></article>") == "Seen and read too"
    assert main_text("<article><p>a <span hidden>never closed <i>b</i>") == "a never closed b"


@pytest.mark.parametrize(
    "page",
    [
        "<a " * 40_000 + '"',
        "<div>text, " * 8_000,
        "<div>" * 8_000 + "</b></p></q></section>" * 8_000 + "text.",
        "<h1>" * 20_000 + "<li><dt><td>x" * 3_000,
        "<span hidden>" * 30_000 + "x",
        "<p><b style='display:none'>" * 20_000,
        "<i class='" + "a-" * 50_000 + "'>x",
        "<!-- " * 30_000 + "<![CDATA[" * 1000,
    ],
)
def test_broken_pages_take_linear_time(page):
    start = time.process_time()
    main_text(page)
    assert time.process_time() - start < 5


def test_blocks_against_labels():
    """Pages put together from labelled pieces: every block of the article, nothing else."""
    r = random.Random(6)
    lost = extra = right = 0
    for _ in range(120):
        kept = [f"<h1>Title {r.randrange(99)}</h1>"]
        for _ in range(r.randrange(3, 9)):
            words = " ".join(r.choice(["alpha", "beta,", "gamma.", "delta"]) for _ in range(r.randrange(12, 60)))
            kept.append(r.choice([f"<p>{words}</p>", f"<p>{words} <a href=x>linked words</a></p>", f"<blockquote><p>{words}</p></blockquote>", f"<ul><li>{words}</li></ul>"]))
        noise = ["<nav><a href=1>Home</a> <a href=2>News</a></nav>", "<div class='sidebar'><p>Some other words, by the side.</p></div>", "<footer><p>All rights reserved, 2020.</p></footer>",
                 "<form><p>Your name</p><input></form>", "<div id='comments'><p>I think so too, friend.</p></div>", "<script>var x = '<p>no</p>';</script>", "<div class='cookie-banner'>We use cookies.</div>"]
        before, after = r.sample(noise, r.randrange(4)), r.sample(noise, r.randrange(4))
        frame_of = r.choice(["<article>{}</article>", "<main>{}</main>", "<div class='post-body'>{}</div>", "<div class=wrap><div class=content>{}</div></div>"])
        page = f"<html><body>{''.join(before)}{frame_of.format(''.join(kept))}{''.join(after)}</body></html>"
        want = Counter(" ".join(re.sub("<[^>]*>", "", k).split()) for k in kept)
        got = Counter(main_text(page).split("\n"))
        right += sum((want & got).values())
        lost += sum((want - got).values())
        extra += sum((got - want).values())
    assert right / (right + lost) >= 0.99 and right / (right + extra) >= 0.99


def test_rows(spark):
    rows = [(1, "u", f"<article>{ARTICLE}</article>", "x"), (2, None, None, "x"), (None, "u", "", "x"), (1, "u", f"<article>{ARTICLE}</article>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in extract_text(pages).collect()), key=str)
    assert got == sorted([(1, "u", TEXT, len(TEXT))] * 2 + [(2, None, "", 0), (None, "u", "", 0)], key=str)
    assert extract_text(pages.limit(0)).count() == 0
