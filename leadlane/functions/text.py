"""Text expressions: blank handling, whitespace, phrase matching.

Parsers in this package take a *cell*: a column already passed through ``to_str``. A plan computes the
cells once in a projection of their own and the parsers then refer to them by name.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlane import rules

# First and last code point of every run of characters counted as whitespace.
_SPACE_RANGES = (
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
)
WHITESPACE = "".join(chr(c) for low, high in _SPACE_RANGES for c in range(low, high + 1))
SPACE = "[" + "".join(rf"\x{{{low:x}}}-\x{{{high:x}}}" for low, high in _SPACE_RANGES) + "]"

_LONGEST_BLANK_TOKEN = max(len(token) for token in rules.BLANK_TOKENS)


def strip(col: Column) -> Column:
    """Trim every kind of whitespace from both ends."""
    return F.btrim(col, F.lit(WHITESPACE))


def blank_to_null(stripped: Column) -> Column:
    """Null where a stripped text is one of the blank tokens. The length test spares long texts the lower()."""
    short = F.octet_length(stripped) <= _LONGEST_BLANK_TOKEN
    return F.when(~(short & F.lower(stripped).isin(*rules.BLANK_TOKENS)), stripped)


def to_str(raw: Column) -> Column:
    """The cell of a raw value: stripped text, or null when it says nothing."""
    return blank_to_null(strip(raw.cast("string")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body refers to it.

    Only for single expressions: it takes them out of generated code, which projections in a row do not.
    """
    return F.transform(F.array(value), body)[0]


def squeeze(cell: Column) -> Column:
    """Collapse whitespace runs to one space. ASCII with single spaces as its only whitespace is left as it is.

    Substring tests tell it, which cost a fraction of a pattern for every character.
    """
    runs = ["  ", *[c for c in WHITESPACE if c.isascii() and c != " "]]
    may_change = reduce(or_, [F.octet_length(cell) != F.char_length(cell), *[cell.contains(r) for r in runs]])
    return F.when(may_change, F.regexp_replace(cell, SPACE + "+", " ")).otherwise(cell)


def clean_text(raw: Column) -> Column:
    return let(to_str(raw), squeeze)


clean_name = clean_company = clean_title = clean_text


def clean_source(raw: Column) -> Column:
    return F.lower(clean_text(raw))


def capitalize(text: Column) -> Column:
    """First character upper, all others lower."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2**31 - 1)))


def fold_case(text: Column) -> Column:
    """Lower case for phrase matching; the two letters that equal s and i without case are mapped by hand."""
    lowered = F.lower(text)
    return F.when(
        text.contains("ſ") | text.contains("ı"), F.translate(lowered, "ſı", "si")
    ).otherwise(lowered)


def needed_text(pattern: str) -> str:
    """The longest plain text every match of a pattern without alternatives must contain."""
    optional = re.compile(r"\(\?<?[!=][^)]*\)|\([^)]*\)\?|(?:\\.|[^\\])[?*]")
    plain = re.sub(r"\\.", "\0", optional.sub("\0", pattern))
    return max(re.split(r"[^\w\s/-]+", plain), key=len)


def matches(text: Column, pattern: str) -> Column:
    """Search for a pattern of top-level alternatives.

    Alternatives without special characters become substring tests, which cost far less than a regex. The
    others run as a regex, and only on texts that contain the plain text they need.
    """
    tests = []
    for part in pattern.split("|"):
        if re.fullmatch(r"[\w\s/-]+", part):
            tests.append(text.contains(part))
        else:
            tests.append(text.contains(needed_text(part)) & text.rlike("(?U)" + part))
    return reduce(or_, tests)


def any_keyword(text: Column, keywords: tuple[str, ...]) -> Column:
    """Whole-word search for any of the keywords."""
    return text.rlike(r"(?U)\b(?:" + "|".join(re.escape(k) for k in keywords) + r")\b")
