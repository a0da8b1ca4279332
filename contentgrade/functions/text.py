"""Text metrics as column expressions.

Word and space classes are spelled out because Java's ``\\w``, ``\\b`` and ``\\s`` do not
cover Unicode in the way the scores require, and ``\\b`` differs between Java versions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
SPACE_RANGE = r"\t-\r\x1c-\x20\x{85}\p{Z}"
SPACE = f"[{SPACE_RANGE}]"
# The same characters one by one, for trimming.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(
    chr(code) for code in (*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)
_END = rf"(?!{WORD})"

# Terms, formula signs and patterns, and citation patterns of the scoring rules.
# Citation patterns meet lower-cased text. They start with literal text and look back from
# its end, because Java can then skip through the text; the last three are separate words of
# one rule that asks for a word boundary only before the first and after the last.
DOMAIN_TERMS = (
    "solvency",
    "solvency ii",
    "ivass",
    "eiopa",
    "riserva",
    "best estimate",
    "premio",
    "longevità",
    "mortalità",
    "stress test",
    "discount rate",
    "risk margin",
    "scr",
    "bscr",
    "premio puro",
    "var",
    "value at risk",
    "tasso tecnico",
    "attuario",
    "riserva matematica",
)
FORMULA_SIGNS = ("=", "≠", "≤", "≥")
FORMULA_PATTERNS = (r"\\begin\{equation\}", r"(?s)\\\[.*?\\\]")
CITATION_PATTERNS = (
    rf"ivass(?<!{WORD}ivass){_END}",
    rf"eiopa(?<!{WORD}eiopa){_END}",
    rf"isvap(?<!{WORD}isvap){_END}",
    rf"solvency(?<!{WORD}solvency){SPACE}*ii{_END}",
    rf"european insurance(?<!{WORD}european insurance){_END}",
    rf"regolament[oi](?<!{WORD}regolament[oi])",
    "circolare",
    rf"normativa{_END}",
)

# The look-behind follows the first digit so that it runs at digits only.
NUMBER_PATTERN = rf"\p{{Nd}}(?<!{WORD}\p{{Nd}})\p{{Nd}}*(?:[.,]\p{{Nd}}+)?{_END}"

_DIGITS = "0123456789"
# Blocks of decimal digits that numbers in running text may use besides ASCII.
_DIGIT_BLOCKS = (0x0660, 0x06F0, 0x0966, 0x09E6, 0x0E50, 0xFF10)
_FOREIGN_DIGITS = "".join(chr(start + i) for start in _DIGIT_BLOCKS for i in range(10))


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.btrim(text, F.lit(SPACES))


def word_count(lowered: Column) -> Column:
    """Number of maximal runs of letters, digits and underscores."""
    return F.regexp_count(lowered, F.lit(f"{WORD}++")).cast("bigint")


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping substring matches of ``term``; byte lengths make this cheap."""
    removed = F.octet_length(text) - F.octet_length(F.replace(text, term, F.lit("")))
    return (removed / F.octet_length(term)).cast("int")


# Lexicons of more terms are searched by one pattern instead of term by term.
TERM_BY_TERM = 100


def trie_pattern(terms: Sequence[str]) -> str:
    """A pattern that matches, where it is tried, the longest of the terms that begins there.

    Terms that begin alike share their beginning, so a place in a text is left at the first
    character that no term has, however many terms there are.
    """
    root: dict = {}
    for term in terms:
        node = root
        for sign in term:
            node = node.setdefault(sign, {})
        node[""] = {}

    def literal(sign: str) -> str:
        return sign if sign.isalnum() else rf"\x{{{ord(sign):x}}}"

    # From the leaves up and without recursion, since a term may be long.
    order, patterns = [root], {}
    for node in order:
        order.extend(child for sign, child in node.items() if sign)
    for node in reversed(order):
        branches = [literal(sign) + patterns.pop(id(child)) for sign, child in node.items() if sign]
        if "" in node:
            patterns[id(node)] = f"(?:{'|'.join(branches)})?" if branches else ""
        else:
            patterns[id(node)] = branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"
    return patterns[id(root)]


def _present_by_trie(text: Column, terms: Sequence[str]) -> Column:
    """The terms that occur anywhere in the text, by one pass over it.

    At each place the longest term is found; all others that begin there are its beginnings.
    """
    known = set(terms)
    nested = [term for term in terms if any(term[:n] in known for n in range(1, len(term)))]
    starts = "".join(sorted({rf"\x{{{ord(term[0]):x}}}" for term in terms}))
    found = F.array_distinct(
        F.regexp_extract_all(text, F.lit(f"(?=[{starts}])(?=({trie_pattern(terms)}))"), F.lit(1))
    )
    if not nested:
        return found

    def beginnings(term: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(term)), lambda n: F.substring(term, F.lit(1), n))
        return F.filter(cut, lambda part: part.isin(*terms))

    closed = F.transform(found, lambda term: F.when(term.isin(*nested), beginnings(term)).otherwise(F.array(term)))
    return F.array_distinct(F.flatten(closed))


def term_counts(lowered: Column, lexicon: Sequence[str] = DOMAIN_TERMS) -> Column:
    """Map from each term that occurs in the lower-cased text to its number of matches.

    Pass a column that is already lower-cased and materialised by an earlier projection: the
    text is searched once per term, or once in all for more than ``TERM_BY_TERM`` terms, and
    copied only for terms that are there.
    """
    terms = [term for term in dict.fromkeys(lexicon) if term]
    if len(terms) > TERM_BY_TERM:
        present = _present_by_trie(lowered, terms)
    else:
        present = F.filter(F.lit(terms), lambda term: F.contains(lowered, term))
    counted = F.transform(present, lambda term: F.struct(term.alias("term"), occurrences(lowered, term).alias("n")))
    return F.map_from_entries(counted)


def numeric_token_list(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER_PATTERN), F.lit(0))


def numeric_tokens(text: Column) -> Column:
    """Number of plain numbers, with at most one decimal point or comma each."""
    return F.regexp_count(text, F.lit(NUMBER_PATTERN)).cast("bigint")


def example_values(tokens: Column, n: int = 20) -> Column:
    """The first ``n`` of the given number tokens as doubles, in text order."""
    plain = F.slice(tokens, 1, n)
    return F.transform(
        plain,
        lambda token: F.translate(token, "," + _FOREIGN_DIGITS, "." + _DIGITS * len(_DIGIT_BLOCKS))
        .try_cast("double"),
    )


def has_formula(
    text: Column,
    signs: Sequence[str] = FORMULA_SIGNS,
    patterns: Sequence[str] = FORMULA_PATTERNS,
) -> Column:
    """True if any of the signs occurs or any of the patterns matches."""
    found = F.lit(False)
    for sign in signs:
        found = found | F.contains(text, F.lit(sign))
    for pattern in patterns:
        found = found | text.rlike(pattern)
    return found


def has_table(html: Column) -> Column:
    return html.rlike("(?i)<table")


def has_list(html: Column) -> Column:
    return html.rlike("(?i)<[uo]l")


def citation_matches(lowered: Column, patterns: Sequence[str] = CITATION_PATTERNS) -> Column:
    """Sum of the matches of all patterns in the lower-cased text."""
    total = F.lit(0)
    for pattern in patterns:
        total = total + F.regexp_count(lowered, F.lit(pattern))
    return total.cast("bigint")
