"""Main text of web pages by templates deduced from the pages of a host."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentgrade.llm.common import quoted, small_or_salted, stored

# A host of fewer pages has no template; a class of fewer tokens or on a smaller part of the
# host's pages is no part of one.
MIN_PAGES = 8
MIN_CLASS = 3
MIN_SUPPORT = 0.5
# Texts of up to so many words are also taken apart into words.
SHORT_TEXT = 8
# Where slots hold a smaller share of a host's text, its pages are copies and tell no template.
MIN_SLOTS = 0.1
# Slots of a mass this near the largest are tied: marks of the elements decide among them.
TIE = 0.5
# A heading beside the main slot belongs to it if what else joins with it has this share at most.
BESIDE = 0.2

# Bits of what a token is.
TAG, OUT, MARKED, HEADING, UNSEEN = 1, 2, 4, 8, 16

# The elements and attribute words of HTML that mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table "
    "tbody tfoot thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPACES = frozenset("br td th img input".split())
OUTSIDE = frozenset("head nav footer aside form menu dialog button select fieldset header object audio video canvas".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu".split())
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside menu nav "
    "navbar navigation breadcrumb breadcrumbs footer masthead notice notices cookie cookies consent gdpr popup modal "
    "overlay newsletter subscribe subscription signup share sharing social related recommended recommendations comment "
    "comments disqus reply replies respond pagination pager toolbar login search copyright disclaimer header".split()
)
ARTICLE_WORDS = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related".split())
CLOSED_BY: dict[str, frozenset[str]] = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
SCOPES = frozenset("html body div article main section table ul ol dl td th li blockquote form aside nav header footer".split())

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_STOP = re.compile(r"""["'>]""")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass(slots=True)
class Piece:
    """A text between two tags."""

    text: str
    path: int
    block: int
    article: bool
    link: bool
    outside: bool
    place: int = 0


def _tag_end(html: str, start: int, lost: set[str]) -> int:
    """Where the tag that begins at ``start`` ends, -1 if it doesn't; quotes may hold a ``>``.

    A quote without a partner is an ordinary character; ``lost`` remembers that none is left,
    so no character is looked at more than twice however many tags are broken.
    """
    at = start
    while True:
        found = _STOP.search(html, at)
        if found is None:
            return -1
        sign = found[0]
        if sign == ">":
            return found.start()
        at = found.end()
        if sign not in lost:
            partner = html.find(sign, at)
            if partner < 0:
                lost.add(sign)
            else:
                at = partner + 1


def _events(html: str) -> Iterator[tuple[str, str, str]]:
    """Texts, opening and closing tags in order: ("text", s, ""), ("open", name, tag), ("close", name, "")."""
    at, n = 0, len(html)
    lost: set[str] = set()
    lower = None
    while at < n:
        start = html.find("<", at)
        if start < 0:
            yield "text", html[at:], ""
            return
        following = html[start + 1 : start + 2]
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            step = n if end < 0 else end + 3
        elif following in ("!", "?"):
            end = html.find(">", start)
            step = n if end < 0 else end + 1
        elif following.isalpha() and following.isascii() or following == "/":
            closing = following == "/"
            name = _NAME.match(html, start + 1 + closing)
            end = _tag_end(html, start, lost)
            if end < 0:
                # The page breaks off inside a tag.
                if start > at:
                    yield "text", html[at:start], ""
                return
            step = end + 1
            if start > at:
                yield "text", html[at:start], ""
            if name is None:
                at = step
                continue
            word = name[0].lower()
            if closing:
                yield "close", word, ""
            else:
                tag = html[start:step]
                yield "open", word, tag
                if word in RAW and not tag.endswith("/>"):
                    if lower is None:
                        lower = html.lower() if html.isascii() else re.sub("[A-Z]+", lambda m: m[0].lower(), html)
                    end = lower.find(f"</{word}", step)
                    end = n if end < 0 else end
                    step = html.find(">", end) + 1 or n
                    yield "close", word, ""
            at = step
            continue
        else:
            # A sign that begins no tag is text, together with what stands before it.
            following_tag = html.find("<", start + 1)
            stop = n if following_tag < 0 else following_tag
            yield "text", html[at:stop], ""
            at = stop
            continue
        if start > at:
            yield "text", html[at:start], ""
        at = step


_paths: dict[tuple, int] = {}


def _hashed(*parts) -> int:
    """A signed 64-bit hash; that of a path or a word is kept for the next page."""
    found = _paths.get(parts)
    if found is None:
        if len(_paths) > 200_000:
            _paths.clear()
        value = xxhash.xxh64_intdigest("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass"))
        found = _paths[parts] = value - (1 << 64) if value >= 1 << 63 else value
    return found


def _marks(tag: str) -> tuple[str, frozenset[str], str]:
    """Class attribute, words of class and id, and role of a tag."""
    if "=" not in tag:
        return "", frozenset(), ""
    kind, words, role = "", [], ""
    for name, *values in _ATTRIBUTE.findall(tag):
        value = next((v for v in values if v), "")
        if name.lower() == "role":
            role = value.lower()
        else:
            words += [w.lower() for w in _WORDS.findall(value)]
            if name.lower() == "class":
                kind = value
    return kind, frozenset(words), role


def parse(html: str) -> tuple[list[Piece], list[int], dict[int, tuple[int, int]]]:
    """The texts of a page, the hashes of its tags in order of their places, and the tags' tree.

    A tag's hash covers its element, its class and those of its ancestors, so equal tags in
    different roles are different tokens. The tree gives the hash of the tag around each and
    the bits of what it is. Missing end tags of paragraphs, list items and
    cells are supplied; end tags without a beginning are ignored.
    """
    pieces: list[Piece] = []
    tokens: list[int] = []
    tree: dict[int, tuple[int, int]] = {}
    # element, path hash, outside, article, link, inside a header of an article
    stack: list[tuple[str, int, bool, bool, bool, bool]] = [("", 0, False, False, False, False)]
    open_names: Counter = Counter()
    block = 0

    def pop_to(name: str) -> None:
        while True:
            top = stack.pop()[0]
            open_names[top] -= 1
            if top == name:
                return

    for kind, value, tag in _events(html):
        if kind == "text":
            if value and not value.isspace():
                _, path, outside, article, link, _ = stack[-1]
                text = unescape(value) if "&" in value else value
                pieces.append(Piece(text, path, block, article, link, outside, len(tokens)))
            elif value and pieces and pieces[-1].block == block:
                pieces.append(Piece(" ", stack[-1][1], block, stack[-1][3], stack[-1][4], stack[-1][2]))
            continue
        if kind == "close":
            if open_names[value]:
                pop_to(value)
            if value in BLOCKS:
                block += 1
            elif value in SPACES and pieces:
                pieces.append(Piece(" ", stack[-1][1], block, stack[-1][3], stack[-1][4], stack[-1][2]))
            continue
        if value in BLOCKS:
            block += 1
            if open_names["p"]:
                for name, *_ in reversed(stack):
                    if name == "p":
                        pop_to("p")
                        break
                    if name in SCOPES:
                        break
        for name in CLOSED_BY.get(value, ()):
            if open_names[name]:
                for other, *_ in reversed(stack):
                    if other == name:
                        pop_to(name)
                        break
                    if other in ("ul", "ol", "dl", "table"):
                        break
        _, path, outside, article, link, header = stack[-1]
        css, words, role = _marks(tag)
        here = _hashed(path, value, css)
        tokens.append(here)
        around = path
        if value in SPACES:
            pieces.append(Piece(" ", path, block, article, link, outside))
        if value in VOID or tag.endswith("/>") and value not in BLOCKS:
            tree.setdefault(here, (around, TAG))
            continue
        if value == "header" and article and not outside:
            header = outside = True
        elif value in HEADINGS and header and article and not words & OUTSIDE_WORDS:
            outside = False
        elif value in OUTSIDE or value in RAW or role in OUTSIDE_ROLES:
            outside = True
        elif value in ("article", "main"):
            outside = outside or bool(words & ARTICLE_WORDS)
        elif value not in ("html", "body") and words & OUTSIDE_WORDS:
            outside = True
        article = article or value == "article" or value == "main" or role in ("main", "article")
        unseen = value in RAW or value == "head" or bool(tree.get(around, (0, 0))[1] & UNSEEN)
        tree.setdefault(here, (around, TAG | OUT * outside | MARKED * article | HEADING * (value in HEADINGS) | UNSEEN * unseen))
        stack.append((value, here, outside, article, link or value == "a", header))
        open_names[value] += 1
    return pieces, tokens, tree


def text_token(piece: Piece) -> int:
    return _hashed(piece.path, "t", " ".join(piece.text.split()))


@dataclass(slots=True)
class Token:
    """How often a token of the template model occurs on a page, and where."""

    n: int
    place: int
    around: int
    bits: int
    chars: int


def page_tokens(html: str) -> dict[int, Token]:
    """The tokens of a page: tags, texts, and the words of short texts outside the article.

    The place of a token is the number of tags before its first occurrence. A tag's ``chars``
    are those of the visible texts inside it that are no links; a text's are its own.
    """
    pieces, tags, tree = parse(html)
    found: dict[int, Token] = {}
    for place, token in enumerate(tags):
        known = found.get(token)
        if known is None:
            found[token] = Token(1, place, *tree[token], 0)
        else:
            known.n += 1
    for piece in pieces:
        words = piece.text.split()
        if not words:
            continue
        visible = not piece.link and not tree.get(piece.path, (0, 0))[1] & UNSEEN
        chars = sum(map(len, words)) * visible
        texts = [(text_token(piece), chars)]
        if 1 < len(words) <= SHORT_TEXT and not piece.article:
            texts += [(_hashed(piece.path, "w", w), 0) for w in words]
        for token, size in texts:
            known = found.get(token)
            if known is None:
                found[token] = Token(1, piece.place, piece.path, 0, size)
            else:
                known.n += 1
                known.chars += size
        if piece.path in found:
            found[piece.path].chars += chars
    # Tags come after those around them, so sums move outwards in one walk back.
    for token in reversed(dict.fromkeys(tags)):
        if tree[token][0] in found:
            found[tree[token][0]].chars += found[token].chars
    return found


def main_text(html: str, template: frozenset[int], region: int = 0) -> str:
    """The article: what stands in the slots of ``region``, the tag around the main slots of a host.

    On a page without that tag, or with nothing in it, a marked article is the region, and
    without one the whole page. Inside, a marked article goes before what is beside it, parts
    that are marked as something else go, and outside a marked article blocks that are mostly
    links and blocks of nothing but fixed texts, which are tokens of the template, unless
    nothing else is there. A fixed text inside a slot, such as a label, belongs to the slot.
    """
    pieces, tags, tree = parse(html)
    inside = [p for p in pieces if not p.outside]
    if region and region in tree:
        within = {region}
        for tag in tags:
            if tree[tag][0] in within:
                within.add(tag)
        main = [p for p in inside if p.path in within]
        if any(not p.text.isspace() for p in main):
            inside = main
    if any(p.article and not p.text.isspace() for p in inside):
        inside = [p for p in inside if p.article]
    else:
        # Without a marked article, blocks that are mostly links are menus.
        total: Counter = Counter()
        linked: Counter = Counter()
        for p in inside:
            total[p.block] += len(p.text.strip())
            linked[p.block] += len(p.text.strip()) * p.link
        inside = [p for p in inside if 2 * linked[p.block] <= total[p.block]]
    if template:
        slots = {p.block for p in inside if not p.text.isspace() and (p.article or text_token(p) not in template)}
        if slots:
            inside = [p for p in inside if p.block in slots]
    lines: list[str] = []
    parts: list[str] = []
    block = None
    for p in inside:
        if p.block != block:
            lines.append("".join(parts))
            parts, block = [], p.block
        parts.append(p.text)
    lines.append("".join(parts))
    return "\n".join(line for line in (" ".join(x.split()) for x in lines) if line)


def _host(url: str | None) -> str:
    found = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", url or "")
    return found[1].rpartition("@")[2].lower() if found else ""


def _nest(tokens: pd.DataFrame) -> pd.DataFrame:
    """The template of one host, and its main region, from the tokens on at least half of its pages.

    Tokens of one occurrence vector are a class; a class is valid if it has enough tokens, a
    tag among them, since texts without markup of their own are content that pages repeat, and
    its places, ordered by the mean, lie either around all of another valid class, or in one
    gap between neighbouring tokens of it, so that the classes form a tree. Larger classes go
    first; a class that would cut across one already taken is left out.
    """
    taken: list[np.ndarray] = []
    chosen: list[int] = []
    groups = sorted((g.sort_values("place") for _, g in tokens.groupby("vector")), key=lambda g: (-len(g), g["token"].min()))
    for group in groups:
        if len(group) < MIN_CLASS or not (group["bits"] & TAG).any():
            continue
        places = group["place"].to_numpy()
        nested = all(
            len(np.unique(np.searchsorted(outer, places))) == 1 or len(np.unique(np.searchsorted(places, outer))) == 1
            for outer in taken
        )
        if nested:
            taken.append(places)
            chosen += group["token"].tolist()
    region = _main_region(tokens, set(chosen))
    if region is None:
        chosen, region = [], 0
    return pd.DataFrame({"host": [tokens["host"].iloc[0]], "template": [sorted(chosen)], "region": [region]})


def _main_region(tokens: pd.DataFrame, template: set[int]) -> int | None:
    """The tag around the main slots, 0 for the whole page, None if there are hardly any slots.

    A tag's mass is the text inside it that isn't fixed, over all pages. From the whole page
    inwards, the tag of the template that occurs once a page and has the most mass is entered,
    as long as it has more than what lies in no such tag. Of tags of about the same mass a
    marked article is taken first and one marked as something else last, and a marked article
    isn't taken apart. If the main slot has no heading, but the tag around it has
    one and little else, it belongs to it.
    """
    by_token = {t.token: t for t in tokens.itertuples(index=False)}
    mass: Counter = Counter()
    total = 0
    for t in by_token.values():
        if t.bits & TAG:
            mass[t.token] += t.chars
            total += t.chars * (t.around == 0)
    whole = total
    for t in by_token.values():
        if t.token in template and not t.bits & TAG:
            total -= t.chars
            at = t.around
            while at in by_token:
                mass[at] -= t.chars
                at = by_token[at].around
    if total < MIN_SLOTS * whole or not whole:
        return None
    inner: dict[int, list[int]] = {}
    outer: dict[int, int] = {}
    for t in by_token.values():
        if t.token in template and t.bits & TAG and not t.bits & UNSEEN and t.times == t.pages:
            at = t.around
            while at in by_token and not (at in template and by_token[at].times == by_token[at].pages):
                at = by_token[at].around
            outer[t.token] = at if at in by_token else 0
            inner.setdefault(outer[t.token], []).append(t.token)

    def rank(tag: int) -> tuple[int, int, int]:
        bits = by_token[tag].bits
        return (2 if bits & OUT else 0 if bits & MARKED else 1), -mass[tag], tag

    region, held = 0, total
    while inner.get(region) and not (region and by_token[region].bits & MARKED):
        most = max(mass[x] for x in inner[region])
        best = min((x for x in inner[region] if mass[x] >= TIE * most), key=rank)
        if by_token[best].bits & (HEADING | OUT) or mass[best] <= held - sum(mass[x] for x in inner[region]):
            break
        region, held = best, mass[best]
    if region and not by_token[region].bits & MARKED and not _heading(region, inner, by_token):
        wider = outer[region]
        while wider and mass[wider] <= (1 + BESIDE) * held:
            if _heading(wider, inner, by_token):
                return wider
            wider = outer[wider]
    return region


def _heading(tag: int, inner: dict[int, list[int]], by_token: dict) -> bool:
    """Whether a heading occurs once a page inside a tag, in nothing that is marked as something else."""
    return any(
        not by_token[x].bits & OUT and (by_token[x].bits & HEADING or _heading(x, inner, by_token)) for x in inner.get(tag, ())
    )


def deduce_templates(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """One row per host of at least ``MIN_PAGES`` pages: the tokens of its template, its main region.

    A page yields each of its tokens with the number of times it occurs and its first place.
    The occurrence vector of a token over the pages of a host is never built: the bitwise
    exclusive or of a hash per page and count stands for it, which partial aggregation
    combines before the shuffle, so a host with a third of all pages is spread like any
    other. Only tokens on at least half of a host's pages, as many as a page can hold, meet
    in one task to be nested.
    """
    numbered = pages.select(F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"), F.monotonically_increasing_id().alias("row"))

    long, int_ = pa.int64(), pa.int32()
    kinds = dict(host=long, token=long, row=long, n=int_, place=int_, around=long, bits=int_, chars=long)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for url, html, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                host = _hashed("host", _host(url))
                found = page_tokens(html or "")
                found[0] = Token(1, 0, 0, 0, 0)  # the page itself
                for token, t in found.items():
                    values = (host, token, row, t.n, t.place, t.around, t.bits, t.chars)
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds.values(), strict=True)], names=list(kinds))

    counted = numbered.mapInArrow(count, "host long, token long, row long, n int, place int, around long, bits int, chars long")
    vectors = counted.groupBy("host", "token").agg(
        F.count("*").alias("pages"),
        F.bit_xor(F.xxhash64("row", "n")).alias("vector"),
        F.avg("place").alias("place"),
        F.sum("n").alias("times"),
        F.min("around").alias("around"),
        F.bit_or("bits").alias("bits"),
        F.sum("chars").alias("chars"),
    )
    frequent = stored(vectors.filter(F.col("pages") >= MIN_PAGES), "page-tokens")
    hosts = frequent.filter("token = 0").select("host", F.col("pages").alias("host_pages"))
    candidates = frequent.filter("token != 0").join(hosts, "host").filter(F.col("pages") >= MIN_SUPPORT * F.col("host_pages"))
    return candidates.groupBy("host").applyInPandas(_nest, "host long, template array<long>, region long")


def extract_main_text(pages: DataFrame, html: str = "html", url: str = "url", text: str = "text") -> DataFrame:
    """Add the main text of every page from its whole html.

    Character references are decoded, white space inside a block becomes one blank, blocks
    are joined by one line end. Null or empty html gives an empty text; a null url or one
    without a host belongs to the host of no name. A column named like the text is replaced;
    all others stay. Repeated pages count as often as they occur.

    Templates meet their pages by a broadcast if they were measured to be small, else by a
    salted join.
    """
    templates = stored(deduce_templates(pages, html, url), "page-templates").withColumnRenamed("host", "_host")
    kept = [c for c in pages.columns if c != text]

    @F.pandas_udf("long")
    def host_hash(urls: pd.Series) -> pd.Series:
        return urls.map(lambda u: _hashed("host", _host(u)), na_action=None).astype("int64")

    @F.pandas_udf("string")
    def extracted(html: pd.Series, template: pd.Series, region: pd.Series) -> pd.Series:
        known: dict[bytes, frozenset[int]] = {}
        out = []
        for page, tokens, tag in zip(html, template, region, strict=True):
            tokens = np.asarray(() if tokens is None else tokens, dtype=np.int64)
            key = tokens.tobytes()
            if key not in known:
                known[key] = frozenset(tokens.tolist())
            out.append(main_text(page or "", known[key], int(tag)))
        return pd.Series(out, dtype=object)

    rows = pages.select(
        F.struct(*[F.col(quoted(c)) for c in kept]).alias("_row"),
        F.col(html).cast("string").alias("_html"),
        host_hash(F.col(url).cast("string")).alias("_host"),
    )
    met = small_or_salted(rows, templates, "_host")
    return met.select("_row.*", extracted("_html", "template", F.coalesce("region", F.lit(0).cast("long"))).alias(text))
