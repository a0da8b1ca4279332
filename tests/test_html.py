"""Parsing against a walk with the standard library's parser."""

import datetime as dt
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from contentgrade.functions import html as H
from contentgrade.operators.links import extract_links
from contentgrade.operators.pages import page_metadata, parse_pages, parse_quality_flags, usable_fetches

FETCH = "url string, html string, fetched_at double, error string"


class Walk(HTMLParser):
    """Text nodes inside the body, or of the whole page if it has none."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.current, self.skip, self.in_body, self.has_body = [], "", [], False, False

    def flush(self):
        if self.current.strip():
            self.nodes.append((self.in_body, self.current.strip()))
        self.current = ""

    def handle_starttag(self, tag, attrs):
        self.flush()
        if tag in ("script", "style", "template"):
            self.skip.append(tag)
        if tag == "body":
            self.in_body = self.has_body = True

    def handle_endtag(self, tag):
        self.flush()
        if self.skip and self.skip[-1] == tag:
            self.skip.pop()
        if tag == "body":
            self.in_body = False

    def handle_comment(self, data):
        self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.current += data

    def text(self):
        self.flush()
        return "\n".join(t for inside, t in self.nodes if inside or not self.has_body)


def parse(spark, *htmls):
    rows = [(f"https://h.example/{i:04d}", html, 1.7e9 + 0.25, None) for i, html in enumerate(htmls)]
    return parse_pages(spark.createDataFrame(rows, FETCH)).orderBy("url").collect()


def test_pages_match_a_parser_walk(spark, sf_dir):
    htmls = [row["html"] for row in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    for html, row in zip(htmls, parse(spark, *htmls)):
        walk = Walk()
        walk.feed(html)
        walk.close()
        assert row["text"] == walk.text()


def test_odd_markup_matches_a_parser_walk(spark):
    htmls = [
        '<body>a<p title="x > y" data-q=\'<b>\'>b</p>c</body>',
        "<body>1 < 2 &amp;&lt;b&gt; &copy;&nbsp;x &egrave; &#232; &#xE8; &euro; &amp;lt;</body>",
        "<body>one<!-- <p>two</p> -->three<script>if (a<b) {'</p>'}</script >four<style>p{}</style></body>",
        "<body>a<template><p>hidden</p></template>b<br/>c</body>",
        "<html><body class=x>only <b>  </b>\n<i>this</i>",
        "<body>end</body> after",
        "<BODY ID=a><DIV>Up</DIV></BODY>",
    ]
    for html, row in zip(htmls, parse(spark, *htmls)):
        walk = Walk()
        walk.feed(html)
        walk.close()
        assert row["text"] == walk.text(), html


def test_metadata(spark):
    full, bare, timed, order = parse(
        spark,
        '<head><title> Solvency &amp; <b>Co</b> </title><meta name="description" content=" Testo ">'
        '<meta content="Anna &quot;B&quot;" name=author>'
        '<meta property="article:published_time" content="2023-01-01">'
        "<meta property='article:modified_time' content='2023-06-20T10:00:00Z'></head><body>x</body>",
        "<body>x</body>",
        '<body><time class=c datetime="2022-05-05">ieri</time><time datetime="2021-01-01">x</time></body>',
        '<meta name="description" content=""><meta name="description" content="later">'
        '<meta content="a name=author b" name="keywords"><script><title>no</title></script><title>T</title>',
    )
    assert full["title"] == "Solvency &Co"
    assert full["metadata"].asDict() == {
        "language": "it",
        "title": "Solvency &Co",
        "description": "Testo",
        "published": "2023-01-01",
        "modified": "2023-06-20T10:00:00Z",
        "author": 'Anna "B"',
    }
    assert bare["title"] == "" and bare["metadata"]["published"] is None and bare["metadata"]["author"] is None
    assert timed["metadata"]["published"] == timed["metadata"]["modified"] == "2022-05-05"
    assert order["metadata"]["description"] is None and order["metadata"]["author"] is None
    assert order["title"] == "T"


def test_fetch_time_and_html_are_kept(spark):
    row = parse(spark, "<body>x</body>")[0]
    assert row["html"] == "<body>x</body>"
    assert row["fetched_at"] == dt.datetime.fromtimestamp(1.7e9 + 0.25, dt.timezone.utc).replace(tzinfo=None)


def test_main_content_without_body(spark):
    rows = parse(
        spark,
        "<nav>menu</nav><article>long enough text</article><div>short</div>",
        "<article>short</article><div>a <div>nested</div> longer text</div><p>rest</p>",
        "</div><div>one<div>two</div>three</div>four",
        "<p>nothing</p> else",
        "<article>same</article><main>same</main>",
        "<div>unclosed <p>text",
        "<article>&amp;&amp;&amp;&amp;</article><div>12345</div>",
    )
    assert [row["text"] for row in rows] == [
        "long enough text",
        "a\nnested\nlonger text",
        "one\ntwo\nthree",
        "nothing\nelse",
        "same",
        "unclosed\ntext",
        "12345",
    ]


def test_entities(spark):
    cases = {
        "a &amp;amp; b": "a &amp; b",
        "AT&T &unknown; & &;": "AT&T &unknown & &;",
        "&#146;&#x41;&#0;&#55296;": "’A��",
        "&#xFFFFFFFFFFFFFFFFFFFF;&#99999999999999999999;": "��",
        "&copy 2020 &copy2020": "© 2020 &copy2020",
        "&Agrave;&agrave;": "Àà",
        "none": "none",
    }
    frame = spark.createDataFrame([(k,) for k in cases], "v string")
    found = {r[0]: r[1] for r in frame.select("v", H.decode_entities(F.col("v"))).collect()}
    assert found == cases


def test_very_long_markup(spark):
    """No pattern recurses or backtracks over long stretches."""
    n = 200_000
    html = (
        "<title>t</title><body " + "a=\"b\" c=d e " * n + ">x" + "<p>" * n + "y" + "&amp;" * n + "&lt;" * 1000
        + "<!--" + "-" * n + "-->" + " " * n + "<a" + " x='1'" * n + " href='/z'>z</a></body>"
    )
    row = parse(spark, html)[0]
    assert row["text"] == "x\ny" + "&" * n + "<" * 1000 + "\nz"
    without_body = parse(spark, "<div>" * 2000 + "x" + "</div>" * 2000)[0]
    assert without_body["text"] == "x"
    fetch = spark.createDataFrame([("https://h.example/", html, 1.0, None)], FETCH)
    assert [r["dst_url"] for r in extract_links(fetch).collect()] == ["https://h.example/z"]


@pytest.mark.parametrize("piece", ["<a ", "<a href='", '<p title="', "<script ", "<title ", "<!d ", "<!--", "<body "])
def test_broken_markup_takes_linear_time(spark, piece):
    """No text is scanned again by every attempt to close a tag."""
    seconds = []
    for size in (30_000, 240_000):
        html = "<body>" + piece * (size // len(piece))
        fetch = spark.createDataFrame([("https://h.example/", html, 1.0, None)], FETCH)
        parse_pages(fetch).collect()
        start = time.perf_counter()
        parse_pages(fetch).collect()
        extract_links(fetch).collect()
        seconds.append(time.perf_counter() - start)
    assert seconds[1] < 8


def test_attribute_entities(spark):
    cases = {
        "?a=1&amp;lang=2&lang=it&copy=3": "?a=1&lang=2&lang=it&copy=3",
        "&quot;A&#39;&egrave;&unknown; & B": "\"A'è&unknown; & B",
        "&amp;amp;": "&amp;",
    }
    frame = spark.createDataFrame([(k,) for k in cases], "v string")
    found = {r[0]: r[1] for r in frame.select("v", H.decode_attribute(F.col("v"))).collect()}
    assert found == cases
    html = '<body><a href="/p?x=1&lang=it&amp;reg=2">l</a></body>'
    fetch = spark.createDataFrame([("https://h.example/", html, 1.0, None)], FETCH)
    assert extract_links(fetch).first()["dst_url"] == "https://h.example/p?x=1&lang=it&reg=2"


def test_usable_fetches_and_flags(spark):
    rows = [
        ("a", "<title>t</title><body>x</body>", 1.0, None),
        ("b", "", 1.0, "Timeout"),
        ("c", None, 1.0, None),
        ("d", "<p></p>", 1.0, ""),
    ]
    usable = usable_fetches(spark.createDataFrame(rows, FETCH))
    flagged = parse_quality_flags(parse_pages(usable)).orderBy("url").collect()
    assert [(r["url"], r["missing_title"], r["missing_text"]) for r in flagged] == [
        ("a", False, False),
        ("d", True, True),
    ]
    assert page_metadata(parse_pages(usable)).first()["metadata"]["url"] == "a"


def test_links(spark):
    html = (
        '<a href="/a/">1</a><A class=x HREF=\'b?x=1&amp;y=2#f\'>2</A><a href="#top">3</a>'
        '<a href="http://h.example/c">4</a><a href="https://other.example/">5</a><a name=z>6</a>'
        '<a href="mailto:x@y">7</a><a href="">8</a><a title="href=/no" href=" ../d ">9</a>'
        '<a href="/a">10</a><a href=//h.example/e>11</a><!-- <a href="/hidden"> --><abbr href="/no">'
    )
    frame = spark.createDataFrame([("https://h.example/dir/page?q=1#z", html, 1.0, None)], FETCH)
    assert {r["dst_url"] for r in extract_links(frame).collect()} == {
        "https://h.example/a",
        "https://h.example/dir/b?x=1&y=2",
        "http://h.example/c",
        "https://h.example/dir/page?q=1",
        "https://h.example/d",
        "https://h.example/e",
    }
    assert extract_links(frame).count() == 6
