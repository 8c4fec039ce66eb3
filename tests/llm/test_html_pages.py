"""Main text of odd pages, in linear time, and of the test pages against a plain reading of their articles."""

import html
import os
import re
import time

import pytest

from perkolat.llm.htmltext import main_text

P = "The way that the old town was built by the river is known to all of us, and it is a story for those who have the time to read it on a long day in the winter of the year when there was no more bread to be had."
Q = "It was in the house of the miller that they had all of the things which we would need for the way, and so we went there with him and her."
SF = "/root/testdata/sf0.001"

CASES = {
    "head without end": (f"<html><head><title>x</title><meta a=b><body><article><p>{P}</p></article>", P),
    "head and body without end": (f"<html><head><title>x</title><p>{P}</p>", P),
    "part of a class": (f"<div class='content has-sidebar'><article><p>{P}</p><p>{Q}</p></article></div>", f"{P}\n{Q}"),
    "share in a class": (f"<div class='share-price-story'><article><p>{P}</p><p>{Q}</p></article></div>", f"{P}\n{Q}"),
    "paragraph without end": (f"<article><p>{P}<p class=promo>Buy the new book of the year that all of us have read by now in the town.<p>{Q}</article>", f"{P}\n{Q}"),
    "item without end": (f"<article><p>{P}</p><ul><li class=social>Follow us on all of the sites</ul><p>{Q}</p></article>", f"{P}\n{Q}"),
    "anchor without end": (f"<article><a name=top><p>{P}</p><p>{Q}</p></article>", f"{P}\n{Q}"),
    "heading in a header": (f"<header>Name of the site</header><article><header><h1>My heading</h1></header><p>{P}</p></article>", f"My heading\n{P}"),
    "teaser": (f"<article>Read more</article><div><p>{P}</p><p>{Q}</p></div>", f"{P}\n{Q}"),
    "comments outside": (f"<article><p>{P}</p></article><div class=comments><p>{P}</p><p>{Q}</p></div>", P),
    "comments inside": (f"<article><p>{P}</p><section id='comments'><p>{Q}</p></section></article>", P),
    "no article": (f"<div id=page><div class=story><p>{P}</p><p>{Q}</p></div><div class=sidebar><p>{Q}</p></div></div>", f"{P}\n{Q}"),
    "text after tags that never end": (f"<p>{P}</p><p>{Q} 1 < 2 <b", f"{P}\n{Q} 1 < 2 <b"),
    "nothing": ("", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_odd_pages(name):
    page, want = CASES[name]
    assert main_text(page) == want


@pytest.mark.parametrize("page", ["<" + "a" * 1_000_000, "<a " * 300_000, "<a \"'>" * 200_000, "<div>" * 200_000, "<p>" * 200_000, "<td>" * 100_000, "<li><b class=ad>x" * 60_000, "<" * 500_000, "</div>" * 200_000])
def test_long_pages_take_linear_time(page):
    began = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - began < 10


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_articles_read_plainly(spark):
    block = r"</?(?:p|h[1-6]|ul|ol|li|div|blockquote|table|tr|td|article|section)\b[^>]*>"
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article\b[^>]*>(.*?)</article>", r["html"], re.S)
        if inner is None or re.search(r"<(?:script|style|aside|form|nav|figure|div)\b", inner[1]):
            continue
        pieces = re.split(block, re.sub(r"<!--.*?-->", "", inner[1], flags=re.S))
        want = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br[^>]*>", " ", x))).split()) for x in pieces]
        assert main_text(r["html"]) == "\n".join(x for x in want if x)
