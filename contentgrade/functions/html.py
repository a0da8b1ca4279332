"""HTML to text and metadata as column expressions.

All of it is regular expressions over whole documents, so a page is parsed inside the scan
stage without leaving the JVM. Repetitions over long stretches are possessive: Java would
otherwise recurse once per repetition. Known limits: only same-named nesting is followed in
pages without ``<body>``, and the content of a CDATA section is dropped.

Expressions that read their input more than once say so; give them a column of an earlier
projection, which Catalyst keeps separate instead of repeating the work.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from contentgrade.functions.text import strip

# Marks every place where a tag, a comment or a skipped element separates two text nodes.
MARK = "\x01"

# A tag ends before the next "<" outside quotes, so no text is looked at by two attempts.
_ATTRIBUTES = r"""(?:[^<>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
_HIDDEN = (
    r"(?is)<(?:!--.*?(?:-->|\z)"
    r"|script(?=[\s/>])[^<>]*+>.*?(?:</script\s*+>|\z)"
    r"|style(?=[\s/>])[^<>]*+>.*?(?:</style\s*+>|\z)"
    r"|template(?=[\s/>])[^<>]*+>.*?(?:</template\s*+>|\z)"
    r"|r[tp](?=[\s/>])[^<>]*+>.*?(?:</r(?:[tp]|uby)\s*+>|\z))"
)
_TAG = rf"(?s)<(?:/?[A-Za-z]{_ATTRIBUTES}|[!?][^<>]*+)>"
_TITLE = r"(?is)<title(?:[\s/][^<>]*+)?+>(.*?)(?:</title\s*+>|\z)"
_BODY_OPEN = r"(?i)<body(?:[\s/][^<>]*+)?+>"
_BODY_CLOSE = r"(?i)</body\s*+>"
_META = rf"(?i)<meta[\s/]{_ATTRIBUTES}>"
_TIME = rf"(?i)<time(?:[\s/]{_ATTRIBUTES})?+>"
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)"""
# Stands for a decoded ampersand while the other references are still encoded.
_AMPERSAND = "\x02"
_ENTITY_NAME = r"\A(#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*)"


def html4_entities() -> dict[str, str]:
    """Named references of HTML 4, ``apos``, and the Windows-1252 reading of 128 to 159."""
    table = {"amp": "&", "apos": "'"}
    table.update({name: chr(code) for name, code in name2codepoint.items()})
    for code in range(0x80, 0xA0):
        text = bytes([code]).decode("cp1252", errors="ignore")
        if text:
            table[f"#{code}"] = table[f"#x{code:x}"] = text
    return table


def _map_literal(table: Mapping[str, str]) -> Column:
    """One string literal that Catalyst folds into a map; cheaper to plan than many literals."""
    text = "\x03".join(f"{name}\x02{value}" for name, value in table.items())
    return F.str_to_map(F.lit(text), F.lit("\x03"), F.lit("\x02"))


def _codepoint_text(number: Column) -> Column:
    valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    return F.when(
        valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    ).otherwise(F.lit("�"))


def _character(name: Column, named: Column) -> Column:
    """What a reference stands for, null if its name is unknown; bad numbers become U+FFFD."""
    code = F.regexp_extract(name, r"\A#([0-9]+)\z", 1)
    hexed = F.regexp_extract(name, r"\A#[xX]0*([0-9A-Fa-f]{1,8})\z", 1)
    number = F.coalesce(
        code.try_cast("bigint"), F.conv(F.nullif(hexed, F.lit("")), 16, 10).try_cast("bigint")
    )
    return F.coalesce(
        F.try_element_at(named, name),
        F.when(F.startswith(name, F.lit("#")), _codepoint_text(number)),
    )


def _decode(text: Column, piece: Callable[[Column], Column]) -> Column:
    """Decode the pieces after each ampersand; the ``&amp;`` are put aside first.

    They are by far the most frequent, so few pieces are left to look up.
    """
    spared = F.replace(text, F.lit("&amp;"), F.lit(_AMPERSAND))
    decoded = F.array_join(
        F.transform(
            F.split(spared, "&"), lambda part, at: F.when(at == 0, part).otherwise(piece(part))
        ),
        "",
    )
    return F.when(~F.contains(text, F.lit("&")), text).otherwise(
        F.replace(decoded, F.lit(_AMPERSAND), F.lit("&"))
    )


def decode_entities(text: Column, table: Mapping[str, str] | None = None) -> Column:
    """Decode the character references of running text once each: ``&amp;lt;`` becomes ``&lt;``.

    The semicolon is optional, and an unknown name keeps its text without it. ``table``
    defaults to the HTML 4 names; pass ``html.entities.html5`` without the semicolons for all
    names of HTML 5.
    """
    named = _map_literal(table or html4_entities())

    def piece(part: Column) -> Column:
        name = F.regexp_extract(part, _ENTITY_NAME, 1)
        rest = F.regexp_replace(F.substr(part, F.length(name) + 1), r"\A;", "")
        known = F.coalesce(_character(name, named), F.concat(F.lit("&"), name))
        return F.when(name == "", F.concat(F.lit("&"), part)).otherwise(F.concat(known, rest))

    return _decode(text, piece)


def decode_attribute(text: Column, table: Mapping[str, str] | None = None) -> Column:
    """Decode an attribute value, where only a reference with a semicolon counts.

    ``?a=1&lang=it`` is a query string and stays as it is.
    """
    named = _map_literal(table or html4_entities())

    def piece(part: Column) -> Column:
        name = F.regexp_extract(part, _ENTITY_NAME + ";", 1)
        known = F.concat(_character(name, named), F.substr(part, F.length(name) + 2))
        return F.coalesce(F.when(name != "", known), F.concat(F.lit("&"), part))

    return _decode(text, piece)


def visible_html(html: Column) -> Column:
    """Replace comments and the elements whose content is never text by a mark."""
    return F.regexp_replace(html, _HIDDEN, MARK)


def marked_text(visible: Column) -> Column:
    """Replace every tag by a mark; entities are still encoded."""
    return F.regexp_replace(visible, _TAG, MARK)


def joined_text(decoded: Column) -> Column:
    """Strip each text node, drop the empty ones and join the rest with newlines."""
    nodes = F.transform(F.split(decoded, MARK), strip)
    return F.array_join(F.filter(nodes, lambda node: node != ""), "\n")


def title(visible: Column) -> Column:
    """Text of the first ``<title>``, empty if there is none."""
    return F.regexp_extract(visible, _TITLE, 1)


def plain_title(marked: Column) -> Column:
    """Strip and concatenate the text nodes of a title whose tags are marked."""
    return F.array_join(F.transform(F.split(marked, MARK), strip), "")


def _first_element(visible: Column, name: str) -> Column:
    """The first element of that name with everything inside it; null if there is none."""
    pieces = F.split(F.concat(F.lit(" "), visible), rf"(?i)(?=</?{name}[\s/>])")
    opening, closing = F.lit(rf"(?i)\A<{name}[\s/>]"), F.lit(rf"(?i)\A</{name}[\s/>]")
    start = F.struct(
        F.lit(0).alias("seen"), F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit(0).alias("depth")
    )

    def step(state: Column, part: Column) -> Column:
        opens = F.rlike(part, opening)
        closes = F.rlike(part, closing)
        inside = (state["first"] > 0) & (state["last"] == 0)
        seen = state["seen"] + 1
        return F.struct(
            seen.alias("seen"),
            F.when((state["first"] == 0) & opens, seen).otherwise(state["first"]).alias("first"),
            F.when(inside & closes & (state["depth"] == 1), seen).otherwise(state["last"]).alias("last"),
            F.when((state["first"] == 0) & opens, F.lit(1))
            .when(inside & opens, state["depth"] + 1)
            .when(inside & closes, state["depth"] - 1)
            .otherwise(state["depth"])
            .alias("depth"),
        )

    def cut(state: Column) -> Column:
        end = F.when(state["last"] > 0, state["last"]).otherwise(state["seen"] + 1)
        return F.when(
            state["first"] > 0,
            F.array_join(F.slice(pieces, state["first"], end - state["first"]), ""),
        )

    return F.aggregate(pieces, start, step, cut)


def main_content(visible: Column) -> Column:
    """The part of the page that counts as its text. Reads its input several times.

    The candidates are the first ``article``, ``main``, ``div`` and ``body``, and the longest
    text wins. A body encloses the other three, so with a body that is the answer; only
    pages without one have to weigh the rest.
    """

    body = F.get(F.split(F.get(F.split(visible, _BODY_OPEN, 2), 1), _BODY_CLOSE, 2), 0)
    # In ascending order of preference between equally long texts.
    candidates = F.array(
        *[
            F.struct(F.lit(rank).alias("rank"), _first_element(visible, name).alias("html"))
            for rank, name in enumerate(("div", "main", "article"))
        ]
    )
    sized = F.transform(
        F.filter(candidates, lambda found: found["html"].isNotNull()),
        lambda found: F.struct(
            F.length(
                decode_entities(F.replace(marked_text(found["html"]), F.lit(MARK), F.lit("")))
            ).alias("size"),
            found["rank"],
            found["html"],
        ),
    )
    return F.coalesce(body, F.array_max(sized)["html"], visible)


def raw_attribute(tag: Column, name: str) -> Column:
    """The attribute as written, quotes included; empty if the tag lacks it.

    The attributes before it are skipped whole, so text inside a quoted value never counts.
    """
    before = rf"(?:[\s/]*+(?!{name}\s*+=)[^\s/=>]++(?:\s*+=\s*+{_VALUE}?+)?+)*+"
    return F.regexp_extract(
        tag, rf"(?is)\A<[a-z][^\s/>]*+{before}[\s/]*+{name}\s*+=\s*+({_VALUE}?)", 1
    )


def unquote(raw: Column) -> Column:
    return F.regexp_replace(raw, r"""(?s)\A(["'])(.*)\1\z""", "$2")


def meta_tags(visible: Column) -> Column:
    """All meta tags as ``array<struct<name, property, content>>``, entities still encoded."""
    return F.transform(
        F.regexp_extract_all(visible, F.lit(_META), F.lit(0)),
        lambda tag: F.struct(
            unquote(raw_attribute(tag, "name")).alias("name"),
            unquote(raw_attribute(tag, "property")).alias("property"),
            unquote(raw_attribute(tag, "content")).alias("content"),
        ),
    )


def meta_content(metas: Column, key: str, value: str) -> Column:
    """Content of the first meta tag whose ``key`` equals ``value``, entities still encoded.

    Null if that tag has no content; later tags are not tried.
    """
    first = F.get(F.filter(metas, lambda tag: tag[key] == value), 0)
    return F.nullif(first["content"], F.lit(""))


def first_time_tag(visible: Column) -> Column:
    return F.regexp_extract(visible, _TIME, 0)


def time_value(tag: Column) -> Column:
    """The ``datetime`` of a time tag, entities still encoded; null if empty or absent."""
    return F.nullif(unquote(raw_attribute(tag, "datetime")), F.lit(""))


def link_targets(visible: Column) -> Column:
    """The ``href`` of every ``<a>``, decoded and stripped, in document order."""
    before = rf"(?:[\s/]*+(?!href\s*+=)[^\s/=<>]++(?:\s*+=\s*+{_VALUE}?+)?+)*+"
    pattern = rf"(?is)<a(?=[\s/]){before}[\s/]*+href\s*+=\s*+({_VALUE}?)"
    raw = F.regexp_extract_all(visible, F.lit(pattern), F.lit(1))
    plain = F.transform(raw, unquote)
    return F.transform(plain, lambda href: F.translate(strip(decode_attribute(href)), "\t\r\n", ""))
