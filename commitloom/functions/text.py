"""Unicode string rules shared by the message and patch functions.

Java's ``\\s`` and ``trim`` know ASCII only; commit text needs the Unicode sets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode whitespace and line-break character sets.
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The classes are in Java syntax. Single characters below 256 share one bit set, and the
# intersection lets other text pass with a single range test: half the cost of one flat class.
WHITESPACE = (
    r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0[\x{1680}-\x{3000}&&"
    r"[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]]"
)
NOT_LINE_BREAK = r"[^\n\x0b\f\r\x1c\x1d\x1e\x85\x{2028}\x{2029}]"
LINE_BREAK_BUT_NEWLINE = r"[\x0b\f\r\x1c\x1d\x1e\x85[\x{2028}-\x{2029}]]"


def strip(text: Column) -> Column:
    """Drop Unicode whitespace on both ends; a character-set trim, so linear on any input."""
    return F.btrim(text, F.lit(WHITESPACE_CHARS))


def squeeze(text: Column) -> Column:
    """Strip, and turn every inner whitespace run into one blank."""
    return F.regexp_replace(strip(text), WHITESPACE + "+", " ")


def words(text: Column) -> Column:
    """Whitespace-separated words; an empty array when there is none."""
    return F.array_remove(F.split(text, WHITESPACE + "+"), "")


def first_line(text: Column) -> Column:
    """Text before the first line break of any kind; '' for an empty text."""
    return F.regexp_extract(text, "^" + NOT_LINE_BREAK + "*", 0)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def present(value: Column) -> Column:
    """Generator of a struct's fields that drops rows where the struct is null.

    Unlike a filter on the computed struct it is evaluated once: a filter would be
    pushed below the projections, with the whole computation copied into it.
    """
    return F.inline(F.array_compact(F.array(value)))
