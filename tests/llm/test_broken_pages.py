"""Broken and nested markup: time linear in the page, and no text or caption lost."""

import time

import pytest

from strataspark.llm import media

BROKEN = ["<a ", "<!--", "<a b='\"> ", "<figure><img src=x>", "<figcaption>x", "</", '<a b="', "<script>", "<figure>", "</figure>", "<", "<a =", "&#9", "<![CDATA[", "<img a='", '=" ']


@pytest.mark.parametrize("part", BROKEN)
def test_a_megabyte_of_broken_markup(part):
    page = part * (1_000_000 // len(part))
    begun = time.monotonic()
    for p in (page, page + ">", "<p title=" + page):
        media.sequence(p)
    assert time.monotonic() - begun < 10


def brief(page):
    return [(i["text"] or i["reference"], i["caption"]) for i in media.sequence(page)]


@pytest.mark.parametrize(("page", "items"), [
    ("<figure><img src=a><figure><img src=b></figure><figcaption>outer</figcaption></figure>tail", [("a", "outer"), ("b", "outer"), ("tail", None)]),
    ("<figure><img src=a><figure><img src=b><figcaption>inner</figcaption></figure><figcaption>outer</figcaption></figure>", [("a", "outer"), ("b", "inner")]),
    ("<figure><figcaption>first</figcaption><img src=a></figure>", [("a", "first")]),
    ("<figure><img src=a><figcaption>open</figure><p>rest", [("a", "open"), ("rest", None)]),
    ("<p>x<figure><img src=a><figcaption>open to the <b>end</b>", [("x", None), ("a", "open to the end")]),
    ("<figcaption>alone</figcaption>", [("alone", None)]),
    ("<img srcset='s.png 2x, t.png'><img src=a srcset=b alt='x &amp; y'>", [("s.png", None), ("a", "x & y")]),
    ("a<!-- b > c --> d <!-- e > f", [("a d f", None)]),
    ("1 < 2 &lt; 3 <a title='>' href=x>4</a><br>5", [("1 < 2 < 3 4", None), ("5", None)]),
    ("x <a title='y", [("x <a title='y", None)]), ("<a title=it's>b</a>", [("b", None)]),
    ("<script>if (a < b) '</p>'</SCRIPT >c<style>d", [("c", None)]), (f"&#{'9' * 9000};", [("�", None)]),
])
def test_items(page, items):
    assert brief(page) == items
