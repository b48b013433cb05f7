"""The main text of generated pages, whose article is known, and of pages that are hard to read."""

from __future__ import annotations

import random
from html import escape
from time import process_time

import pytest
from cinefold.llm import htmltext
from cinefold.llm.htmltext import main_text
from pyspark.sql import functions as F

WORDS = "the house and its river were old, when it came. to see: what others had not; long before (they said) & after".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def article(rng, depth=0):
    """(markup, blocks of text) of an article's inside."""
    markup, blocks = [], []

    def put(open_, text, close):
        markup.append(f"{open_}{escape(text)}{close}")
        blocks.append(" ".join(text.split()))

    kinds = rng.choices(["p", "p", "p", "h", "linked", "list", "odd", "div", "section"], k=rng.randrange(3, 9))
    for kind in ["p", *kinds]:
        if kind == "p":
            put("<p>", sentence(rng, rng.randrange(12, 60)), rng.choice(["</p>", ""]))
        elif kind == "h":
            put("<h2>", sentence(rng, 3), "</h2>")
        elif kind == "linked":
            put("<h3><a href=/x>", sentence(rng, 3), "</a></h3>")
        elif kind == "list":
            markup.append("<ul>")
            for _ in range(rng.randrange(1, 4)):
                put("<li><a href='#'>", sentence(rng, 4), "</a></li>")
            markup.append("</ul>")
        elif kind == "odd":
            put(rng.choice(['<section id="search-engines"><p>', '<div class="social-history"><p>', '<div class="Comment policy-text"><p>', '<section class="footer-notes-of-the-river"><p>']).replace('"Comment policy-text"', '"comment-policies"'), sentence(rng, 20), "</p>" + "</div>" * 0)
            markup[-1] += "</section>" if markup[-1].startswith("<section") else "</div>"
        elif kind == "div" and depth < 2:
            put("<div>", sentence(rng, 25), "</div>")
        elif kind == "section" and depth < 2:
            inner, more = article(rng, depth + 1)
            tag = rng.choice(["section", "div"])
            markup.append(f"<{tag}>{inner}</{tag}>")
            blocks += more
    return "".join(markup), blocks


BEFORE = ["<nav><ul><li><a href=/>Home</a><li><a href=/n>News, all.</a></ul></nav>", "<header><h1>The Site</h1><p>It says, this and that.</p></header>", '<div class="cookie-notice"><p>We use cookies, as others do. Fine?</p></div>', '<div id="ad-box"><p>Buy this, or that. Now.</p></div>', "<form><p>Your name, please.</p><input></form>"]
BEHIND = ["<aside><p>A side note, of some words.</p></aside>", '<section class="comments"><p>Reader one says, well, no.</p><p>Reader two: yes.</p></section>', '<div class="related-posts"><p>Read this, too.</p></div>', "<footer><p>&copy; all of us, always.</p></footer>", '<ul class="share-buttons"><li><a href=x>one</a></ul>']
AROUND = ["<article>{}</article>", "<main>{}</main>", "<div>{}</div>", "<div class=post><div class=entry>{}</div></div>", "<main><div><article><header><h1>The head</h1></header>{}</article></div></main>"]


@pytest.mark.parametrize("seed", range(4))
def test_generated_articles_are_kept_whole(seed):
    rng = random.Random(seed)
    for _ in range(150):
        inner, blocks = article(rng)
        around = rng.choice(AROUND)
        blocks = ["The head", *blocks] if "The head" in around else blocks
        before, behind = (rng.sample(x, rng.randrange(len(x) + 1)) for x in (BEFORE, BEHIND))
        page = "".join([*before, around.format(inner), *behind])
        for html in (page, f"<html><body>{page}</body></html>", f"<body><div id=wrap><div>{page}</div></div>"):
            assert main_text(html) == " ".join(blocks)


P = "<p>A sentence of some length, with commas. And another one, also long enough.</p>"


@pytest.mark.parametrize(
    "inner",
    [
        f"<article><section>{P * 8}</section><section>{P * 2}</section></article>",
        f"<article><h1>Title</h1><p>Intro, it is.</p><div>{'Body text, long. ' * 30}</div></article>",
        f"<main><h1>Title</h1><div>{'Body text, long. ' * 30}</div></main>",
        f"<div><div>{P * 6}</div><div>{P * 2}</div><div>{P * 2}</div></div>",
        f"<article><h2><a href=x>Linked head</a></h2>{P * 3}<ul><li><a href=1>one link</a><li><a href=2>two</a></ul></article>",
        f"<article><header><h1>T</h1></header>{P * 3}</article>",
    ],
)
def test_nothing_of_the_article_is_lost(inner):
    whole = " ".join(__import__("re").sub("<[^>]*>", " ", inner).split())
    for page in (inner, f"<body><nav><a href=/>Home</a></nav>{inner}<footer>&copy; me.</footer>", f"<div><nav><a href=/>Home</a></nav><div>{inner}</div></div><footer>x</footer>"):
        assert main_text(page) == whole


def test_each_step_decides_some_page(monkeypatch):
    """Smoothing, punctuation and the threshold each change what is chosen without hints."""
    lines = "".join(f"<div><h4>{w}</h4></div>" for w in ("one", "two", "three"))
    pages = [f"<body><table><tr><td>{w}</td></tr></table><div>{P * 4}</div>{lines}<dl><dd>{x}</dd></dl>" for w in ("tag", "tag one two three", "a b. c, d. e, f.") for x in ("z", "no stop at all here but words", "one, two.")]
    far = "".join(f"<h{k}>x</h{k}>" for k in range(2, 7))  # short paths between a paragraph and what stands last
    pages += [f"<body><div>{P * k}</div>{far}<dl><dd>{x}</dd></dl>" for k in (1, 4) for x in ("z", "zz", "zzz", "zzzz")]
    usual = [main_text(x, False) for x in pages]
    for change in ({"_smoothed": lambda x: x}, {"_PUNCTUATION": __import__("re").compile("(?!)")}, {"THRESHOLD": 0.0}, {"THRESHOLD": 0.5}):
        for name, value in change.items():
            monkeypatch.setattr(htmltext, name, value)
        assert [main_text(x, False) for x in pages] != usual, change
        monkeypatch.undo()


@pytest.mark.parametrize("part", ["<!--", "<script ", "<script>", '<a "', "</i>", "<i><div>", "<b>", "<div class='", "<p><i>", "<td><li>", "</", "<![CDATA[", "&amp", "<a href=\"x\" ", "<style>x</styl", "\n"])
def test_a_page_of_one_megabyte_takes_seconds(part):
    for html in (part * (1_000_000 // len(part)), "<i><div>" + "<b>" * 50_000 + part * 50_000 + "</i>" * 50_000):
        began = process_time()
        main_text(html)
        assert process_time() - began < 5


def test_links_of_hard_pages(spark):
    """The URL filter's link patterns on unclosed markup, and what they still find."""
    from cinefold.llm.urlfilter import links_of

    parts = ["<!--", "<script ", "<script>", "<link ", '<link rel="', "<link rel=x ", "<meta http-equiv=", "</script ", "<!-- -->", '<link rel="canonical" href="']
    pages = [(p * (1_000_000 // len(p)),) for p in parts] + [("<link " + "rel=x " * 150_000 + ">",)]
    began = __import__("time").time()
    assert [len(r[0]) for r in spark.createDataFrame(pages, "html string").select(links_of(F.col("html"))).collect()] == [0] * 11
    assert __import__("time").time() - began < 30
    some = [('<link rel="canonical" href="/a"><link href=/b rel=canonical><LINK REL=\'x canonical\' HREF=\'/c\'><link rel=alternate href=/d><!-- <link rel=canonical href=/e> --><script><link rel=canonical href=/f></script><meta http-equiv=refresh content="0; url=/g">',)]
    assert spark.createDataFrame(some, "html string").select(links_of(F.col("html"))).first()[0] == ["/a", "/b", "/c", "/g"]
