"""Url functions against urllib."""

from urllib.parse import urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from contentgrade.functions import urls as U

BASES = ["https://h.example", "http://h.example/", "https://h.example/a/b", "https://h.example:8080/a/b/?q=1", "https://h.example/a//b/c"]
HREFS = [
    "x", "x/", "/x", "/x//y", "//o.example/z", "?p=2", "../x", "../../../x", "./x", ".", "..", "x/./y/../z",
    "/../x", "a//b", "http://h.example/q", "HTTPS://h.example/Q", "mailto:a@b", "javascript:void(0)", "",
    "x?y=../z", "https:rel", "x#f", "/a/b/..", "a/b/.",
]
URLS = [
    "https://h.example/a/", "https://h.example/", "https://h.example", "HTTPS://H.example/a//", "https://h.example/a?x=/",
    "https://h.example/a?#f", "https://h.example/a/?", "https://h.example/?b#", "/", "a/", "https://h.example/a#b?c", "https://h.example/a?b?",
]


def normal(url):
    parsed = urlparse(url)
    out = parsed._replace(fragment="").geturl()
    if out.endswith("/") and out != f"{parsed.scheme}://{parsed.netloc}/":
        out = out[:-1]
    return out


def test_normalize_url(spark):
    frame = spark.createDataFrame([(u,) for u in URLS], "u string")
    for url, found in frame.select("u", U.normalize_url(F.col("u"))).collect():
        assert found == normal(url), url


def test_resolve_url(spark):
    pairs = [(b, h) for b in BASES for h in HREFS]
    frame = spark.createDataFrame(pairs, "b string, h string").withColumn("p", U.url_parts(F.col("b")))
    for base, href, found in frame.select("b", "h", U.resolve_url(F.col("p"), F.col("h"))).collect():
        assert normal(found) == normal(urljoin(base, href)), (base, href)


def test_label_key_is_idempotent(spark):
    frame = spark.createDataFrame([(u,) for u in [*URLS, " http://h.example/a// ", "http://http://x/"]], "u string")
    once = frame.select("u", U.label_url_key(F.col("u")).alias("k"))
    for url, key, again in once.select("u", "k", U.label_url_key(F.col("k"))).collect():
        expected = url.strip().rstrip("/")
        if expected.startswith("http://"):
            expected = expected.replace("http://", "https://", 1)
        assert key == again == expected


def test_same_site(spark):
    frame = spark.createDataFrame(
        [("https://h.example/a",), ("http://h.example",), ("https://h.example:1/",), ("ftp://h.example/",), ("/a",)], "u string"
    )
    found = [r[0] for r in frame.select(U.same_site(F.col("u"), F.lit("h.example"))).collect()]
    assert found == [True, True, False, False, False]


@pytest.mark.parametrize("bad", ["h.example", "https://", ""])
def test_site_of_rejects(bad):
    with pytest.raises(ValueError):
        U.site_of(bad)
