"""WARC archives by round trip, and the main text of pages."""

import base64
import gzip
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from contentgrade.llm import extraction, warc
from contentgrade.llm.queries import QUERIES
from contentgrade.session import scratch_path


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


PAGES = [
    (1, "http://a/1", "same"),
    (2, "http://a/2\r\nX: y", "same"),
    (3, None, "same"),
    (4, "http://a/4", None),
    (5, "http://a/5", ""),
    (6, "http://a/6", "\r\n\r\nWARC/1.1\r\n\r\n" * 50),
    (7, "http://a/7", "é\n" * 5000 + "\r"),
    (8, "http://a/8", "x" * 100_000),
    (None, "http://a/9", "alone"),
    (10, "http://a/10", "twice"),
    (10, "http://a/10", "twice"),
]


@pytest.mark.parametrize("segment,chunk", [(1 << 20, 1 << 20), (1000, 300), (300, 1000), (7, 5)])
def test_round_trip(spark, segment, chunk):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    path = scratch_path(spark, "warc-test")
    warc.write_warc(pages, path, segment_bytes=segment)
    chunks = warc.read_warc_chunks(spark, path, chunk_bytes=chunk).collect()
    by_record: dict = {}
    for r in chunks:
        assert r["chunk"] is None or len(r["chunk"]) <= chunk
        by_record.setdefault((r["record_id"], r["record_type"]), []).append(r)
    for key, url, html in PAGES:
        data = (html or "").encode()
        kind = "revisit" if key in (1, 2, 4) else "response"
        parts = by_record[(f"<urn:page:{'null' if key is None else key}>", kind)]
        if key == 10:
            assert len([p for p in parts if p["last"]]) == 2
            continue
        parts.sort(key=lambda r: r["chunk_no"])
        assert [p["chunk_no"] for p in parts] == list(range(len(parts)))
        assert [p["last"] for p in parts] == [False] * (len(parts) - 1) + [True]
        assert (parts[-1]["bytes_so_far"], parts[-1]["digest_so_far"]) == (len(data), digest(data))
        if kind == "revisit":
            assert parts[-1]["refers_to"] == f"<urn:page:{5 if key == 4 else 3}>"
            continue
        seen = b""
        for p in parts:
            seen += bytes(p["chunk"])
            assert (p["bytes_so_far"], p["digest_so_far"]) == (len(seen), digest(seen))
        assert seen == data


def test_archive_is_plain_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/1", "<p>\n</p>")], "page_id long, url string, html string").coalesce(1)
    warc.write_warc(pages, str(tmp_path / "w"))
    (file,) = Path(tmp_path / "w").glob("part*.gz")
    data = gzip.decompress(file.read_bytes())
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    assert head.startswith(b"WARC/1.1\r\n") and data.endswith(b"<p>\n</p>\r\n\r\n")
    assert len(rest) == int(fields[b"Content-Length"]) + 4


def test_damage_is_noticed(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/1", "good payload")], "page_id long, url string, html string").coalesce(1)
    warc.write_warc(pages, str(tmp_path / "w"))
    (file,) = Path(tmp_path / "w").glob("part*.gz")
    file.write_bytes(gzip.compress(gzip.decompress(file.read_bytes()).replace(b"good", b"evil")))
    for crc in Path(tmp_path / "w").glob(".part*"):
        crc.write_bytes(b"")
    with pytest.raises(Exception):
        warc.read_warc_chunks(spark, str(tmp_path / "w")).collect()


def test_no_pages(spark):
    path = scratch_path(spark, "warc-empty")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_warc_chunks(spark, path).collect() == []


def test_warc_query(spark, sf_dir):
    found = {r["page_id"]: r for r in QUERIES["op2_warc"](spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(found) == len(pages)
    largest: dict = {}
    for p in pages:
        largest[p["html"]] = max(largest.get(p["html"], -1), p["page_id"])
    for p in pages:
        r, data = found[p["page_id"]], (p["html"] or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), digest(data))
        assert r["refers_to"] == (None if largest[p["html"]] == p["page_id"] else largest[p["html"]])


def text_of(html: str) -> str:
    return extraction.main_text(html, frozenset())


def test_what_is_not_the_article_goes():
    page = """<html><head><title>T</title><style>p{}</style></head><body class="with-sidebar">
    <header>Site</header><nav><ul><li><a href=a>Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
    <aside>Side</aside><article><h1>Head</h1><script>var x = "<p>";</script><p>One &amp; two&nbsp;&eacute;
    three<p><b>bold</b>er<br>line</p><div class="ad">Buy</div><form>Mail <input></form><ul><li>a<li>b</ul>
    <table><tr><td>c<td>d<tr><td>e</table><!-- <p>not this</p> --></article>
    <section class="comments"><article class="comment">Nice</article></section><footer>End</footer></body></html>"""
    assert text_of(page) == "Head\nOne & two é three\nbolder line\na\nb\nc d\ne"


@pytest.mark.parametrize(
    "html,text",
    [
        ("", ""),
        ("plain & simple", "plain & simple"),
        ("<p>a < b and c > d</p>", "a < b and c > d"),
        ("<article><p>one", "one"),
        ("<article>one<p", "one"),
        ("<p title='a > b'>x</p>", "x"),
        ("<p title=\"it's\">x</p><p>y</p>", "x\ny"),
        ("<article></article><p>y</p>", "y"),
        ("<P>x<BR/>y</P>", "x y"),
        ("<script>never closed <p>x", ""),
        ("</div></p>x", "x"),
        ("<p>&#x41;&#66;&notanentity;&lt;b&gt;</p>", "AB¬anentity;<b>"),
    ],
)
def test_odd_markup(html, text):
    assert text_of(html) == text


@pytest.mark.parametrize("piece", ["<a ", "<a href='", "<!--", '<p title="', "<p>", "</p>", "<script>", "<p a='b\" c='>"])
def test_broken_markup_takes_linear_time(piece):
    import time

    start = time.process_time()
    text_of(piece * (400_000 // len(piece)))
    assert time.process_time() - start < 5


def template_page(i: int) -> str:
    return (
        f"<body><div class=top>Our paper</div><div class=c><h1>Title {i}</h1><p><b>Note:</b> text {i}</p>"
        f"<p>Read more stories</p><p>Second {i * 7}</p></div><div class=end>Printed in town</div></body>"
    )


def test_fixed_texts_of_a_host_go(spark):
    rows = [(i, f"http://h.example/{i}", template_page(i)) for i in range(20)]
    rows += [(100, "http://other.example/", template_page(1)), (101, None, None), (102, "no url", ""), (103, "", " ")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("old")).repartition(4)
    found = {r["page_id"]: r["text"] for r in extraction.extract_main_text(pages).collect()}
    assert len(found) == len(rows)
    for i in range(20):
        assert found[i] == f"Title {i}\nNote: text {i}\nSecond {i * 7}"
    assert found[100] == "Our paper\nTitle 1\nNote: text 1\nRead more stories\nSecond 7\nPrinted in town"
    assert found[101] == found[102] == found[103] == ""


def test_equal_pages_keep_their_text(spark):
    rows = [(i, "http://h.example/", "<article><p>The same everywhere</p></article>") for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["text"] for r in extraction.extract_main_text(pages).collect()} == {"The same everywhere"}
    assert extraction.extract_main_text(pages.limit(0)).collect() == []


def test_near_copies_of_an_article_keep_their_paragraphs(spark):
    shared = [f"Paragraph {k} of an article that many pages repeat" for k in range(5)]
    rows = []
    for i in range(20):
        lines = ["News in brief", *(shared if i < 12 else [f"Own text {i} {k}" for k in range(5)]), f"Printed on day {i}"]
        html = "<body><nav>Menu</nav><article><h2>" + lines[0] + "</h2>" + "".join(f"<p>{x}</p>" for x in lines[1:]) + "</article></body>"
        rows.append((i, "http://h.example/", html, "\n".join(lines)))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, expected string")
    for r in extraction.extract_main_text(pages).collect():
        assert r["text"] == r["expected"]


def layout(i: int, lines: list[str], marked: bool) -> str:
    """A page of a host; unmarked ones name nothing that tells what an element is."""
    around = "<article>%s</article>" if marked else "<div class=x4>%s</div>"
    side, talk, foot = (("aside", "section class=comments", "footer") if marked else ("div class=x2", "div class=x5", "div class=x6"))
    said = "".join(f"<p>Reader {i * 3 + k} says this about it</p>" for k in range(1 + i % 2))
    return (
        f"<body><div class=x1><a href=/{i}>Go {i}</a> <a href=/b>Back</a></div><{side}>Tip {i}: look here</{side.split()[0]}>"
        + around % (f"<h1>{lines[0]}</h1>" + "".join(f"<p>{x}</p>" for x in lines[1:]))
        + f"<{talk}>{said}</{talk.split()[0]}><{foot}>Printed in town, visited {i} times</{foot.split()[0]}></body>"
    )


@pytest.mark.parametrize("copies", [0, 12])
def test_templates_find_the_article_without_marks(spark, copies):
    shared = [f"Paragraph {k} of an article that many pages repeat" for k in range(5)]
    rows = []
    for i in range(20):
        body = shared if i < copies else [f"Own text {i} {k} with some more words in it" for k in range(4 + i % 3)]
        lines = [f"News number {i}", *body, f"Day {i}"]
        for host, marked in (("plain", False), ("marked", True)):
            rows.append((i, f"http://{host}.example/{i}", layout(i, lines, marked), "\n".join(lines)))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, expected string").repartition(5)
    for r in extraction.extract_main_text(pages).collect():
        assert r["text"] == r["expected"], r["url"]
    for _, url, html, expected in rows:
        assert (text_of(html) == expected) == ("marked" in url)


def test_title_beside_the_text_belongs_to_it(spark):
    rows = []
    for i in range(10):
        html = (
            f"<body><div class=q1>Our paper</div><div class=q2><div class=q3><h1>Title {i}</h1></div><div class=q4>"
            + "".join(f"<p>Text {i} {k} of some length, as texts have</p>" for k in range(2 + i % 4))
            + f"</div></div><div class=q5>{'Say %d and more. ' % i * 4}</div></body>"
        )
        lines = [f"Title {i}", *(f"Text {i} {k} of some length, as texts have" for k in range(2 + i % 4))]
        rows.append((i, "http://h.example/", html, "\n".join(lines)))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, expected string")
    for r in extraction.extract_main_text(pages).collect():
        assert r["text"] == r["expected"]


def test_extraction_query_against_cutting_out_the_article(spark, sf_dir):
    import re
    from html import unescape

    found = {r["page_id"]: r for r in QUERIES["op1_extraction"](spark, sf_dir).collect()}
    for p in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        article = re.search(r"(?s)<article>(.*?)</article>", p["html"])[1]
        blocks = [unescape(re.sub("<[^>]*>", "", b)) for b in re.split(r"</?(?:p|h1)>", article)]
        expected = "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)
        assert found[p["page_id"]]["text"] == expected
        assert found[p["page_id"]]["n_chars"] == len(expected)
