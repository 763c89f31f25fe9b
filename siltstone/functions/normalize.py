"""Normal form of a function's code, for telling copies.

Text inside triple quotes, comment lines, blank lines and spacing are taken
out.  The whole rule is four regular-expression replacements in linear time,
so it stays inside generated code and needs no state per line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import LINE_SPACE

_REST = r"[^\n]*+"
# Spacing other than one plain space; printable characters are passed by a cheap test.
_SPACING = rf"(?=[^!-~\n])(?: (?={LINE_SPACE})|(?! ){LINE_SPACE}){LINE_SPACE}*+"


def _plain_region(quote: str) -> str:
    """From a line with the quote through the next later line with it."""
    return rf"(?=[^\n]*?{quote}){_REST}(?:[\s\S]*?{quote}{_REST}|[\s\S]*+)"


def _balanced_region(quote: str) -> str:
    """As above, but an even number of quotes leaves the state as it was."""
    pair = rf"(?:[^\n]*?{quote}[^\n]*?{quote})"
    even = rf"{pair}*+(?![^\n]*?{quote}){_REST}"
    odd = rf"{pair}*+[^\n]*?{quote}{_REST}"
    return rf"(?:{odd}(?:\n{even})*+(?:\n{odd}|\z)|{pair}++(?![^\n]*?{quote}){_REST})"


_REGIONS = {
    mode: rf"(?md)^(?:{region(chr(34) * 3)}|(?![^\n]*?{chr(34) * 3}){region(chr(39) * 3)})"
    for mode, region in (("reference", _plain_region), ("balanced", _balanced_region))
}


def normalized_code(code: Column, mode: str = "reference") -> Column:
    """Code without docstrings, comments, blank lines and extra spacing.

    In ``reference`` mode a line with a triple quote always opens or closes a
    region, so a docstring on one line hides what follows it.  In ``balanced``
    mode a line on which the quotes pair up hides only itself.
    """
    quoted = code.contains('"""') | code.contains("'''")
    text = F.when(quoted, F.regexp_replace(code, _REGIONS[mode], "")).otherwise(code)
    text = F.regexp_replace(text, _SPACING, " ")
    text = F.trim(F.regexp_replace(text, r" ?\n[ \n]*", "\n"), F.lit(" \n"))
    return F.trim(F.regexp_replace(text, r"(?md)^#[^\n]*\n?", ""), F.lit("\n"))


def code_hash(code: Column, mode: str = "reference") -> Column:
    return F.md5(normalized_code(code, mode))
