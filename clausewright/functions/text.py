"""String helpers with whole-Unicode semantics, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every code point that counts as white space when stripping.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Fixed value: search tokens keep dotted abbreviations and decimal numbers together.
TOKEN_PATTERN = r"[a-z0-9]+(?:\.[a-z0-9]+)*"


def rx(pattern: str, ignore_case: bool = False, multiline: bool = False) -> str:
    """Java spelling of a Unicode-aware pattern; lines end at newline only."""
    return f"(?{'md' if multiline else ''}{'iu' if ignore_case else ''}U){pattern}"


def ws_trim(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def find_all(col: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))


def tokenise(col: Column) -> Column:
    """Lower-cased search tokens, in order and with repeats."""
    return find_all(F.lower(col), TOKEN_PATTERN)


def contains_any(col: Column, words: tuple[str, ...]) -> Column:
    """True when the text contains at least one of the words as a substring."""
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(col, F.lit(word))
    return hit


def left(col: Column, n: int) -> Column:
    return F.substring(col, 1, n)


def blank_to(col: Column, default: str) -> Column:
    return F.when(F.coalesce(col, F.lit("")) == "", F.lit(default)).otherwise(col)
