"""Rules of main text on pages by hand: what names mark, what lists and lone blocks are, and time in proportion to length."""

import time

import pytest

from tallyhouse.llm import html

S = "It is the text that we have been told of and it goes on with the words that we know."
OTHER = "Den här texten handlar bara svenska ting utan gemensamma ord någonstans alls eller annat märkligt"


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<article><section id='social-history'><h2>Social history</h2><p>{S}</p></section></article>", f"Social history\n{S}"),
        (f"<article><p>{S}</p><p class='related-work'>{S}</p></article>", f"{S}\n{S}"),
        (f"<article><p>{S}</p></article><div class='reply'><p>{S}</p></div><section class='discussion'><p>{S}</p></section>", S),
        (f"<article><p>{S}</p><section class='discussion'><p>{S}</p></section></article>", f"{S}\n{S}"),
        (f"<article><p>{S}</p><div class='userComments'><p>{S}</p></div></article>", S),
        (f"<div class='cookiebar'>{S}</div><article><p>{S}</p></article>", S),
        (f"<article><p>{S}</p><p>Copyright law is older than it.</p></article>", f"{S}\nCopyright law is older than it."),
        (f"<article><p>{S}</p><p>Copyright 2024 by us</p></article>", S),
        (f"<article><p>{S}</p><h2>Sources</h2><ul><li><a href=x>One source</a><li><a href=y>Another source</a></ul></article>", f"{S}\nSources\nOne source\nAnother source"),
        (f"<div><a href=x>Home</a> <a href=y>News</a></div><h1>Title here</h1><p>{S}</p><p>Short end.</p><div>© 2020 us</div>", f"Title here\n{S}\nShort end."),
        (f"<div><a href=x>Home</a></div><p>{OTHER}</p><p>{OTHER}</p>", f"{OTHER}\n{OTHER}"),
        (f"<article><div class='article-header'><h1>T</h1></div><p>{S}</p><div class='related-posts'><p>{S}</p></div><div class='ad-slot'>Buy it</div></article>", f"T\n{S}"),
        (f"<div class='post-header'><h1>T</h1></div><p>{S}</p><div class='page-header'>Our site</div>", f"T\n{S}"),
        (None, ""),
        ("<ul></ul></p></div>", ""),
    ],
)
def test_pages(page, want):
    assert html.main_text(page) == want


def test_no_pages(spark):
    df = spark.createDataFrame([(1, "u", "<p>x", "clash", 3)], "page_id long, url string, html string, text string, n_chars int")
    assert html.extract(df.where("false")).count() == 0 and html.extract(df).columns == ["page_id", "url", "text", "n_chars"]


@pytest.mark.parametrize("page", [lambda n: "<ul>" + "<li>a" * n, lambda n: "<div>" * n + "</ul>" * n, lambda n: "<p>a</p>" * n, lambda n: f"<p>{S}</p>" + "<a href=x>y</a><p>" * n, lambda n: "<div class='a-b" * n])
def test_time_is_in_proportion(page):
    took = []
    for n in (5_000, 40_000):
        began = time.process_time()
        html.main_text(page(n))
        took.append(time.process_time() - began)
    assert took[1] < 30 * max(took[0], 0.02)
