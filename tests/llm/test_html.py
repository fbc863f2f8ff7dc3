from __future__ import annotations

import re
from html import unescape

from pyspark.sql import functions as F

from tidemark.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T &amp; T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Menu one</a><li><a>Menu two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, as everyone does, on this and that page of ours.</p></div>
<div id="wrap"><div class="{name}"><h1>{title}</h1>
<p>First   paragraph &eacute;t&#233; with <b>bold</b> and <a href="x">a link</a>, long enough, to be text.</p>
<div class="ad-box">Buy now, buy cheap, buy all the things that you never needed at all.</div>
<p>Second paragraph,<br>after a break, also long enough to count as a paragraph of text.
<p>Third, unclosed &lt;p&gt; paragraph with more words, and even more words.
<form><p>Subscribe to this, to that, and to everything else we send around the world.</p></form>
<ul><li>item one<li>item two</ul></div>
<aside><p>Read also this other story, which is long, very long, and full of commas.</p></aside>
<section class="comments"><p>Commenter says something long, much longer, and with many, many commas.</p></section></div>
<footer><p>Copyright, imprint, terms, contact, and everything else that nobody reads.</p></footer></body></html>"""

TEXT = """{title}
First paragraph été with bold and a link, long enough, to be text.
Second paragraph, after a break, also long enough to count as a paragraph of text.
Third, unclosed <p> paragraph with more words, and even more words.
item one
item two"""


def test_pages_of_a_host_agree(spark):
    rows = [(i, f"https://www.A.example/x/{i}?q", PAGE.format(name=f"post post-{i}", title=f"Title {i}"), "clash") for i in range(12)]
    short = "<html><body><div id=wrap><div class='post post-99'><p>Only a few words.</p></div><p>Elsewhere, a longer, much longer text, that is not the article at all.</p></div></body></html>"
    rows += [(99, "https://www.a.example/s", short, "clash")]
    rows += [(100, None, None, "c"), (101, "x", "", "c"), (102, "http://b.example/", "<nav>menu</nav>", "c"), (102, "http://b.example/", "<nav>menu</nav>", "c")]
    rows += [(None, "http://c.example", "plain &amp; simple", "c"), (103, "http://c.example", "<p>" + "word " * 100_000, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string").withColumn("paths", F.lit(1))
    found = html.main_text(pages).collect()
    assert len(found) == len(rows)
    by_id = {r.page_id: r for r in found}
    for i in range(12):
        assert by_id[i].text == TEXT.format(title=f"Title {i}")
        assert by_id[i].n_chars == len(by_id[i].text) and by_id[i].url == rows[i][1]
    assert by_id[100].text == by_id[101].text == by_id[102].text == "" and by_id[100].n_chars == 0
    assert by_id[None].text == "plain & simple" and by_id[103].n_chars == 499_999
    assert html.main_text(pages.limit(0)).count() == 0


def test_winning_paths(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.format(name="post", title="t")) for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = html.host_paths(pages).collect()
    assert [r.host for r in found] == ["a.example"]
    assert found[0].paths[0] == "html>body>div.wrap>div.post"


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    sources = {r.page_id: r.html for r in pages.collect()}
    for r in html.main_text(pages).collect():
        inner = re.search(r"<article>(.*)</article>", sources[r.page_id], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", b))).split()) for b in re.split(r"</?(?:h1|p|li|ul|div)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b)


def test_broken_markup():
    for page in ("<", "<p", "</p></div>", "<a <b>x</b>", "<div class='x>y", "<!-- never closed", "<script>var x", "a<br/>b<p/>c", "<p>x</div></p>y"):
        html.extract(page, [])
        html.votes(page)
    assert html.extract("<body><p>a < b &amp;&nbsp;c &lt;i&gt;</p></body>", []) == "a < b & c <i>"


def test_articles_are_whole():
    long = "".join(f"<p>Sentence {i} of the body, long enough to count, goes on here.</p>" for i in range(40))
    links = "<div><a href=a>first link in a list</a> <a href=b>second link in a list</a></div>"
    page = f"<body>{links}<article><h1>Title</h1><p>The lead, direct in the article.</p><div class=body>{long}</div></article></body>"
    path = "body>article>div.body"
    for winners in ([], [path]):
        got = html.extract(page, winners).split("\n")
        assert got[:2] == ["Title", "The lead, direct in the article."] and len(got) == 42
    parts = f"<body>{links}<div class=all><div class=part>{long}</div><div class=part><p>Short end.</p></div></div></body>"
    for winners in ([], ["body>div.all>div.part"]):
        got = html.extract(parts, winners).split("\n")
        assert got[-1] == "Short end." and len(got) == 41
    beside = f"<body><div class=text>{long}</div>{links}</body>"
    assert len(html.extract(beside, []).split("\n")) == 40
