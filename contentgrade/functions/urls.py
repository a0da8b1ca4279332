"""URL expressions: parts, normal forms and relative references (RFC 3986)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contentgrade.functions.text import strip

_SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*"
_ROOT = rf"{_SCHEME}://[^/?#]*/"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, rf"\A({_SCHEME}):", 1))


def netloc(url: Column) -> Column:
    """Host and port as written; empty if the url names none."""
    return F.regexp_extract(url, rf"\A(?:{_SCHEME}:)?//([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, rf"\A(?:{_SCHEME}:)?(?://[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    """The query with its question mark, empty if there is none."""
    return F.regexp_extract(url, r"(?s)\A[^?#]*(\?[^#]+)", 1)


def drop_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)#.*", "")


def normalize_url(url: Column) -> Column:
    """Canonical page url: no fragment, no bare ``?``, lower-case scheme, and one trailing
    slash dropped unless only the root is left. ``https://h`` and ``https://h/`` stay apart.
    """
    bare = F.regexp_replace(drop_fragment(url), r"(?s)\A([^?]*)\?\z", "$1")
    head = F.regexp_extract(bare, rf"\A{_SCHEME}:", 0)
    lowered = F.concat(F.lower(head), F.substr(bare, F.length(head) + 1))
    return F.regexp_replace(lowered, rf"(?s)\A(?!{_ROOT}\z)(.*)/\z", "$1")


def label_url_key(url: Column) -> Column:
    """Key by which labels and pages meet: trimmed, no trailing slashes, always https."""
    trimmed = F.regexp_replace(strip(url), r"/+\z", "")
    return F.regexp_replace(trimmed, r"\Ahttp://", "https://")


def same_site(url: Column, site: Column) -> Column:
    """True for http and https urls whose host and port equal ``site``."""
    return (netloc(url) == site) & scheme(url).isin("http", "https")


def site_of(base_url: str) -> str:
    """Host and port of a base url; an error if it has no scheme or no host."""
    from urllib.parse import urlsplit

    parts = urlsplit(base_url)
    if not parts.scheme or not parts.netloc:
        raise ValueError(f"base url needs a scheme and a host: {base_url}")
    return parts.netloc


def url_parts(url: Column) -> Column:
    """The parts that :func:`resolve_url` needs of a base url, to be worked out once per page."""
    return F.struct(
        scheme(url).alias("scheme"),
        netloc(url).alias("netloc"),
        path(url).alias("path"),
        query(url).alias("query"),
    )


def _remove_dot_segments(merged: Column) -> Column:
    segments = F.split(merged, "/")
    walked = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, segment: F.when(
            segment == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        )
        .when(segment == ".", done)
        .otherwise(F.concat(done, F.array(segment))),
    )
    joined = F.array_join(walked, "/")
    return F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(joined, F.lit("/"))).otherwise(
        joined
    )


def resolve_url(base: Column, href: Column) -> Column:
    """Resolve a reference against the parts of its page. Reads ``href`` several times."""
    own_scheme = scheme(href)
    foreign = (own_scheme != "") & (own_scheme != base["scheme"])
    rest = F.when(own_scheme != "", F.regexp_replace(href, rf"\A{_SCHEME}:", "")).otherwise(href)
    prefix = F.concat(base["scheme"], F.lit("://"), base["netloc"])
    ref_path = F.regexp_extract(rest, r"(?s)\A[^?#]*", 0)
    tail = F.substr(rest, F.length(ref_path) + 1)
    folder = F.when(base["path"] == "", F.lit("/")).otherwise(
        F.regexp_replace(base["path"], r"[^/]*\z", "")
    )
    merged = F.when(F.startswith(ref_path, F.lit("/")), ref_path).otherwise(
        F.regexp_replace(F.concat(folder, ref_path), "/{2,}", "/")
    )
    cleaned = F.when(merged.rlike(r"(?:\A|/)\.\.?(?:/|\z)"), _remove_dot_segments(merged)).otherwise(
        merged
    )
    rooted = F.when(F.startswith(cleaned, F.lit("/")), cleaned).otherwise(
        F.concat(F.lit("/"), cleaned)
    )
    return (
        F.when(foreign, href)
        .when(F.startswith(rest, F.lit("//")), F.concat(base["scheme"], F.lit(":"), rest))
        .when((ref_path == "") & F.startswith(rest, F.lit("?")), F.concat(prefix, base["path"], rest))
        .when(ref_path == "", F.concat(prefix, base["path"], base["query"], rest))
        .otherwise(F.concat(prefix, rooted, tail))
    )


def percent_decoded(text: Column) -> Column:
    """Undo percent escapes; text with a malformed escape stays as it is."""
    kept_plus = F.replace(text, F.lit("+"), F.lit("%2B"))
    return F.when(
        F.contains(text, F.lit("%")), F.coalesce(F.try_url_decode(kept_plus), text)
    ).otherwise(text)


def robots_path(url: Column) -> Column:
    """Path, query and fragment of a url in the form that robots rules are compared with."""
    rest = F.regexp_replace(url, rf"\A(?:{_SCHEME}:)?(?://[^/?#]*)?", "")
    return F.when(rest == "", F.lit("/")).otherwise(percent_decoded(rest))
