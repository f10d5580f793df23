"""Whole texts of pages whose main text was marked by hand, and pages of deep mark-up."""

import time

import duckdb
import pytest

from gridloom.llm import html_text

LINES = [
    "A quiet morning began in the harbour, and the boats were late.", "Nobody had told the crew, so they waited on the pier for news.",
    "The captain came at noon with a letter from the owners.", "It said that the journey would start a week later than planned.",
    "They went home, and some of them did not come back at all."]
TEXT = "".join(f"<p>{line}</p>" for line in LINES)
LINKS = "<ul>" + "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in ("Home", "News", "Boats", "About us")) + "</ul>"
REMARKS = "".join(f"<div><b>Guest {n}</b><p>I think that number {n} says it all about the boats in the harbour today.</p></div>" for n in range(30))


@pytest.fixture(scope="module")
def field():
    rows = duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' ORDER BY page_id").fetchall()
    return html_text.train(html_text.labelled_pages([r[0] for r in rows if r[0]][:200]))


PAGES = {
    "plain": TEXT,
    "body named like side matter": f'<html><body class="page has-sidebar">{TEXT}</body></html>',
    "header and social": f'<body><div class="with-header social">{TEXT}</div></body>',
    "search result": f'<body><div class="post search-result hidden-xs">{TEXT}</div></body>',
    "logged in": f'<body class="logged-in header-fixed"><article>{TEXT}</article></body>',
    "form around the page": f'<body><form id="aspnetForm" action="x">{TEXT}</form></body>',
    "form around an article": f'<body><form id="aspnetForm"><div id="menu">{LINKS}</div><article>{TEXT}</article></form></body>',
    "sidebar in the layout's name": f'<body><main><div class="layout-sidebar-right"><article>{TEXT}</article></div></main></body>',
    "wrappers in wrappers": f'<body class="with-nav"><div class="header-fixed notice"><form><div class="related-layout">{TEXT}</div></form></div></body>',
    "sidebar beside": f'<body class="has-nav"><nav>{LINKS}</nav><div class="page-with-sidebar"><div class="content">{TEXT}</div><div class="sidebar">'
                      f'<p>Read our other stories about the sea and its people today.</p>{LINKS}</div></div><div class="footer"><p>Copyright 2020 by the '
                      f'harbour office and all of its many friends.</p></div></body>',
    "more remarks than text": f'<body><div class="post">{TEXT}</div><div class="comments">{REMARKS}</div></body>',
    "remarks within the article": f'<body><article>{TEXT}<section class="comments">{REMARKS}</section></article></body>',
    "hidden notice": f'<body><div style="display:none"><p>This text is not shown to anybody who reads the page, ever.</p></div><div>{TEXT}</div></body>',
    "scripts and styles": f"<head><title>T</title><style>p {{ x }}</style></head><body><script>var a = '<p>no</p>';</script>{TEXT}<noscript></noscript></body>",
}


@pytest.mark.parametrize("name", PAGES)
def test_whole_texts(field, name):
    assert html_text.extract(PAGES[name], field) == "\n".join(LINES)


def test_pages_without_main_text(field):
    assert html_text.extract(f"<body><nav>{LINKS}</nav><footer>© 2020</footer></body>", field) == ""
    assert html_text.extract("", field) == ""


@pytest.mark.parametrize("page", [
    "<div>" * 64_000 + "text", "<div class=a>x y z" * 16_000, "<li><td><p><svg><div>" * 13_000 + "x", "<b>" * 64_000 + "x</i>" * 20_000,
    "<ul><li>" * 32_000 + "<li>" * 32_000, "<svg><foreignobject>" * 20_000 + "<div>x" * 20_000, "<div>" * 30_000 + "<td></td>" * 30_000],
    ids=["nested", "with text", "mixed", "inline", "lists", "foreign", "cells"])
def test_deep_mark_up_takes_linear_time(page):
    start = time.thread_time()
    html_text.features(html_text.blocks_of(page))
    assert time.thread_time() - start < 5


def test_wrappers_and_side_matter():
    page = f'<div class="social"><nav>{LINKS}</nav>{TEXT}<div class="related"><p>Other stories of the sea and its people.</p></div></div>'
    blocks = html_text.blocks_of(page)
    elements = html_text.placed(blocks)
    assert [(e.tag, e.wrapper, e.beside) for e in elements if e.tag in ("div", "nav")] == [
        ("div", True, False), ("nav", False, True), ("div", False, True)]
    assert [b.text for b in blocks if not b.within.beside] == LINES
