"""Shapes of pages with the exact text expected."""

import pytest

from segq.llm import html_text

P = "It was the best of times and it was the worst of times, as the book has it in the first line of all."
Q = "There is a lot to say about the city and the people who live in it, and this is only a part of that."
C = "I think that this is a very good text and I was glad to read it in the morning with a cup of tea."
NAV = '<ul class="menu"><li><a href="/">Home</a></li><li><a href="/b">All the news of the day</a></li></ul>'

KEPT = [
    f'<div class="layout has-sidebar"><p>{P}</p><p>{Q}</p></div>',
    f'<div class="with-nav"><p>{P}</p><p>{Q}</p></div>',
    f'<div class="post category-legal"><p>{P}</p><p>{Q}</p></div>',
    f'<section class="post tag-discussion"><p>{P}</p><p>{Q}</p></section>',
    f'<main><div class="row no-sidebar"><p>{P}</p><p>{Q}</p></div></main>',
    f'<body class="sidebar-right"><div class="page-with-sidebar"><p>{P}</p><p>{Q}</p></div></body>',
    f'<div class="content-sidebar"><div><p>{P}</p></div><p>{Q}</p></div>',
    f'<div id="header-main"><article><p>{P}</p><p>{Q}</p></article></div>',
    f'<div class="legal"><p>{P}</p><p>{Q}</p></div>',
    f'<div class="search-result-page"><p>{P}</p><p>{Q}</p></div>',
    f'<div class="sidebar-layout"><div class="col">{NAV}<p>{P}</p><p>{Q}</p></div></div>',
    f'<div class="nav-wrapper"><main><p>{P}</p><p>{Q}</p></main></div>',
    f'<div class="type-notice status-publish"><p>{P}</p><p>{Q}</p></div>',
    f'<div class="widget-area">{NAV}</div><article class="post format-link tag-ads"><p>{P}</p><p>{Q}</p></article>',
    f'<article class="has-share"><div class="is-related"><p>{P}</p></div><p>{Q}</p></article>',
    f"<div><p>{P}</p></div><div><p>{Q}</p></div>",
    f'<header class="masthead"><h1>Site</h1></header><div class="no-comments"><p>{P}</p><p>{Q}</p></div>',
    f'<main>{NAV}<p>{P}</p><div class="ad-slot">Buy it now and be the first to have it of all your friends.</div><p>{Q}</p></main>',
    f'<p>{P}</p><div class="cookie-banner"><p>{C}</p></div><p>{Q}</p>',
    f'<div><p>{P}</p><p>{Q}</p></div><div id="comments"><p>{C}</p><p>{C}</p><p>{C}</p></div>',
    f'<div class="social"><div class="post"><p>{P}</p><p>{Q}</p></div></div><div class="comments"><p>{C}</p></div>',
    f'<div class="related"><article><p>{P}</p><p>{Q}</p></article><div class="comment-list"><p>{C}</p></div></div>',
    f'<nav><p>{C}</p></nav><div class="promo"><p>{P}</p><p>{Q}</p></div><footer><p>{C}</p></footer>',
    f'<div class="main"><p>{P}</p><p>{Q}</p></div><div class="site-footer"><p>{C}</p></div>',
    f'<article><p>{P}</p><p>{Q}</p></article><div class="sidebar"><article><p>{C}</p></article></div>',
    f'<div><p>{P}</p><form class="newsletter"><p>{C}</p></form><p>{Q}</p></div>',
    f'<div class="post"><p>{P}</p><aside><p>{C}</p></aside><p>{Q}</p><div class="share-bar">Share it with a friend</div></div>',
]


@pytest.mark.parametrize("page", KEPT)
def test_article_is_kept_and_the_rest_left_out(page):
    assert html_text.main_text(f"<html>{page}</html>").split("\n") == [P, Q]


@pytest.mark.parametrize("page", ["", None, "<nav>menu</nav>", f'<div id="comments"><p>{C}</p></div>', f'<div class="cookies"><p>{C}</p></div>', f"<footer><p>{P}</p></footer>", f'<div class="nav"><ul><li><a href="/">All of the news</a></li></ul></div>'])
def test_pages_without_an_article_have_no_text(page):
    assert html_text.main_text(page) == ""


def test_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars long, x string"
    rows = [(1, "u", KEPT[0], "old", 5, "x")] * 3 + [(None, None, None, None, None, None), (2, "v", "<p>" + (P + " ") * 20000, "", 0, "")]
    got = html_text.html_text(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5 and sum(r.text == f"{P}\n{Q}" for r in got) == 3
    assert next(r for r in got if r.page_id == 2).n_chars == len((P + " ") * 20000) - 1
    assert html_text.html_text(spark.createDataFrame([], schema)).count() == 0
