import itertools
import random
import time

import pytest

from docflow.llm import html_extract as H
from docflow.llm import url_filter as U

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1><a href=/>Home</a></header><nav><ul><li><a href="/a">Menu</a></ul></nav><!-- ad --><div class="ad">Buy now. Really good stuff.</div>
<div class="cookie-notice">We use cookies.</div><article><header><h1>Big &amp; news</h1></header><p><b>First  line.<br><p>Second &lt;line&gt;&nbsp;here.</p><ul><li>One point.<li>Two</ul><form>Name <input></form>
<aside>Related story</aside><blockquote>Said so.</blockquote></article><div id="comments"><p>Nice article, I read it all.</p></div><div class="sidebar"><p>Other long text that is about something else.</p></div><footer>&copy; me</footer></body></html>"""


def test_article_only():
    assert H.content_of(PAGE) == ["Big & news", "First line.", "Second <line> here.", "One point.", "Two", "Said so."]


def test_names_of_wrappers_veto_nothing():
    body = "<header class='entry-header'><h1>The title</h1></header><p>A long sentence that goes on for a while and says things.</p><p>Another one follows it here, with more words.</p>"
    want = ["The title", "A long sentence that goes on for a while and says things.", "Another one follows it here, with more words."]
    for name in ("content-sidebar-wrap", "site-content has-sidebar", "no-sidebar", "container with-banner", "legal-article", "search-result-content"):
        junk = "<div class='left-sidebar-box'><p>Other text, read this as well.</p></div><div id=my-comments><p>Nice one.</p></div><div class='ad'>Buy now. Really good stuff for all of you.</div>"
        assert H.content_of(f"<body><div class='{name}'><article>{body}</article></div>{junk}</body>") == want, name
        assert H.content_of(f"<body><div class='{name}'>{body.replace('header', 'div')}</div><div class='ad'>Buy now.</div></body>")[1:] == want[1:], name
    for attributes in ("title='The hidden life'", 'data-x="is hidden here"', "data-hidden=1"):
        assert H.content_of(f"<article {attributes}>{body}</article>") == want
    for attributes in ("hidden", "HIDDEN=''", "class=x hidden id=y"):
        assert H.content_of(f"<article>{body}<div {attributes}>Out of sight.</div></article>") == want


SAYS = ["A long sentence that goes on for a while and says things.", "Another one follows it here, with more words."]
BODY = "".join(f"<p>{x}</p>" for x in SAYS)

#: (page, text of its main part)
LABELLED = [
    (f"<article><header class='entry-header'><h1>Title</h1></header>{BODY}</article>", ["Title", *SAYS]),
    (f"<article><div class='post-header'><h1>Title</h1></div>{BODY}</article>", ["Title", *SAYS]),
    (f"<article><h1>T</h1>{BODY}<section id='discussion'><h2>Discussion</h2>{BODY}</section></article>", ["T", *SAYS, "Discussion", *SAYS]),
    (f"<article><h1>T</h1>{BODY}<section class='related work'><h2>Related work</h2>{BODY}</section></article>", ["T", *SAYS, "Related work", *SAYS]),
    (f"<div class='banner-layout page-wrap'><article><h1>T</h1>{BODY}</article></div><div class=banner>Buy this now, it is good for you.</div>", ["T", *SAYS]),
    (f"<article><h1>T</h1>{BODY}<ul><li><a href=x>One link of words</a><li>Two things</ul></article>", ["T", *SAYS, "One link of words", "Two things"]),
    (f"<article><h1>T</h1>{BODY}<div class='comments'><p>Nice article, I read it all, and it was good for me to see.</p></div><div id=comment-list><p>I think so too, it is a nice thing to read.</p></div></article>", ["T", *SAYS]),
    (f"<div><h1>T</h1>{BODY * 3}</div><div class='comments-section'><p>Nice article, I read it all, and it was good for me.</p></div><div class='newsletter box'>Get our mails now.</div>", ["T", *SAYS * 3]),
    (f"<main><h1>T</h1>{BODY}</main><div class=cookie-notice><p>We use cookies. Do you agree with all of them?</p></div><aside><p>{SAYS[0]}</p></aside><footer><p>{SAYS[1]}</p></footer>", ["T", *SAYS]),
    (f"<div role=banner><p>{SAYS[0]}</p></div><div id=content><h2>T</h2>{BODY}<form><p>{SAYS[0]}</p></form></div><div role=contentinfo><p>{SAYS[1]}</p></div>", ["T", *SAYS]),
]


def test_labelled_pages():
    assert [H.content_of(f"<body>{page}</body>") for page, _ in LABELLED] == [want for _, want in LABELLED]


#: Pages on which looking back over open elements or ahead for the end of a tag would take time in their square.
DEEP = {
    "open quotes": "<a '" * 20001, "ends of nothing": "<b>" * 20000 + "</i>" * 20000, "paragraph out of reach": "<p><td>" + "<h1>" * 20000, "items out of reach": "<li><ul>" + "<b>" * 10000 + "<li>x</li>" * 10000, "blocks in a deep place": "<b>" * 20000 + "x<hr>" * 20000,
    "names in names": "<div class=x-ad>y" * 20000, "a quote that never ends": "<a '>'" * 20000 + '"', "declarations": "<!" * 40000, "comments": "<!--" * 40000, "attributes": "<a " + "x " * 40000 + ">t", "articles": "<article>" * 20000 + "x", "blocks": BODY * 5000, "cells": "<table>" + "<tr><td>x" * 10000,
}


@pytest.mark.parametrize("name", DEEP)
def test_any_markup_takes_linear_time(name):
    began = time.process_time()
    H.content_of(DEEP[name])
    assert time.process_time() - began < 5


def test_page_without_article_element():
    page = "<body><div id=nav><a href=x>Home</a> <a href=y>About</a></div><div><h2>Head</h2><p>A long sentence that goes on for a while and says things.</p><p>Another one follows it here, with more words.</p></div><ul><li><a href=1>Link one</a><li><a href=2>Link two</a></ul>"
    assert H.content_of(page) == ["Head", "A long sentence that goes on for a while and says things.", "Another one follows it here, with more words."]


def test_rows(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "v", "<p>Only text. It is a sentence of some words.", "x"), (1, "u", PAGE, "x"), (5, "w", "<p>" + "word " * 200_000, "x"), (6, "b", "<<<a <b <!-- never", "x")]
    out = H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(out) == 7 and all(r["n_chars"] == len(r["text"]) for r in out)
    by = {(r["page_id"], r["url"]): r["text"] for r in out}
    assert by[2, None] == by[3, "u"] == "" and by[None, "v"].startswith("Only text") and len(by[5, "w"]) == 5 * 200_000 - 1
    assert H.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_cut_is_minimal():
    r = random.Random(4)
    for _ in range(150):
        n = r.randint(1, 8)
        keep, drop = [r.choice([0, 1, 2.5, 4]) for _ in range(n)], [r.choice([0, 1, 2.5, 4]) for _ in range(n)]
        edges = [(a, b, r.choice([0.5, 1, 2])) for a, b in itertools.combinations(range(n), 2) if r.random() < 0.5]
        price = lambda side: sum(d if s else k for s, k, d in zip(side, keep, drop, strict=True)) + sum(c for a, b, c in edges if side[a] != side[b])  # noqa: B023, E731
        best = min(price(s) for s in itertools.product([False, True], repeat=n))
        assert abs(price(H.minimum_cut(keep, drop, edges)) - best) < 1e-9


def judged(spark, rows, **options):
    out = U.judge(spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, alias string"), **options)
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}


def test_rules(spark):
    out = judged(spark, [(1, "HTTP://A.Example.ORG/es/5?x", None), (2, "http://example.org/en/12", None), (3, "http://example.org/x", None), (4, "http://b.com/fr/", None), (5, "http://b.com/de/9#t", None), (6, "http://notorg/x", None), (7, None, None), (8, "no scheme", None), (9, "http://x.org", None)])
    assert out[1] == ("a.example.org", "/es/5", "example.org/es/", "block") and out[2][2:] == ("example.org/en/1", "block") and out[3][2:] == ("org/", "allow")
    assert out[4][2:] == ("com/fr/", "allow") and out[5] == ("b.com", "/de/9", "com/de/", "block") and out[6] == ("notorg", "/x", None, "allow")
    assert out[7] == out[8] == ("", "", None, "allow") and out[9] == ("x.org", "", None, "allow")


def brute_verdicts(rows):
    """The same by hand, for URLs of the shape scheme://[www.]host/path[/][?utm_x=1][#y] and canonical links."""
    form = lambda u: u.partition("://")[2].partition("#")[0].partition("?")[0].removeprefix("www.").rstrip("/")
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for _, url, link in rows:
        if link:
            a, b = sorted((find(form(url)), find(form(link))))
            root[b] = a
    own = {}
    for page, url, _ in rows:
        host, slash, path = url.partition("://")[2].partition("#")[0].partition("?")[0].partition("/")
        fits = [(len(r), ok) for r, ok in U.RULES if ("." + host).endswith("." + r.partition("/")[0]) and (slash + path).startswith("/" + r.partition("/")[2])]
        own[page] = max(fits, default=(0, None))[1]
    decided = {}
    for page, url, _ in rows:
        if own[page] is not None:
            decided.setdefault(find(form(url)), set()).add(own[page])
    return {page: "allow" if (own[page] if own[page] is not None else True in decided.get(find(form(url)), {True})) else "block" for page, url, _ in rows}


def test_verdicts_equal_brute_force(spark):
    r = random.Random(8)
    urls = [f"{s}://{w}{h}{p}{t}" for s in ("http", "https") for w in ("", "www.") for h in ("a.net", "b.com", "example.org", "c.info", "d.eu") for p in ("/de/1", "/fr/2", "/es/3", "/en/1x", "/q") for t in ("", "/", "?utm_x=1", "#y")]
    rows = [(i, r.choice(urls), r.choice(urls) if r.random() < 0.3 else None) for i in range(150)]
    rows += [(900 + i, f"http://chain.net/{i}", f"http://chain.net/{i + 1}") for i in range(40)] + [(990, "http://b.com/de/77", "http://chain.net/20")]
    out = judged(spark, [(i, u, f"<link rel=canonical href={c}>" if c else None) for i, u, c in rows])
    want = brute_verdicts(rows)
    assert {i: v[3] for i, v in out.items()} == want and want[900] == "block" and set(want.values()) == {"allow", "block"}


def test_urls_of_any_length_repeated_rows_and_an_empty_table(spark):
    long = "http://" + "x" * 200_000 + "://" * 1000 + "/de/"
    out = judged(spark, [(1, long, "<link " * 20_000 + "<!--" * 20_000), (2, "http://b.com/de/" + "y" * 500_000, "<script" * 20_000), (2, "http://b.com/de/" + "y" * 500_000, None)])
    assert out[1][0] == "x" * 200_000 + ":" and out[1][3] == "allow" and out[2][2:] == ("com/de/", "block")
    assert U.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_decisions_reach_aliases(spark):
    canonical = lambda u: f'<link rel="canonical" href="{u}">'
    rows = [
        (1, "http://b.com/de/1", None), (2, "http://c.net/1", canonical("http://b.com/de/1")), (3, "http://c.net/2", '<META http-equiv=refresh content="0; url=/1">'), (4, "https://www.c.net/2/?utm_source=f#top", None),
        (5, "http://d.net/1", canonical("http://e.net/9") + canonical("http://b.com/de/1")), (6, "http://x.org/ok", canonical("http://d.net/7")), (7, "http://d.net/7", canonical("http://b.com/de/8")), (8, "http://b.com/de/8", None), (9, "http://free.net/", None),
    ]
    out = judged(spark, rows)
    assert [out[k][3] for k in (1, 2, 3, 4, 5)] == ["block"] * 5
    assert (out[6][3], out[7][3], out[8][3], out[9][3]) == ("allow", "allow", "block", "allow")
    many = U.RULES + [(f"h{k}.net/", False) for k in range(300)]
    assert judged(spark, [(1, "http://a.h7.net/x", None), (2, "http://q.org/", None)], rules=many) == {1: ("a.h7.net", "/x", "h7.net/", "block"), 2: ("q.org", "/", "org/", "allow")}
