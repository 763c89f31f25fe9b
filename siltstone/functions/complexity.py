"""Branch score of a function's text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import SPACE, WORD_END, WORD_START

# The words and signs that count one each.  ``else if`` counts on
# top of its ``if``; ``=>`` and every bracket left open count one half.
BRANCH_WORDS = (
    "if",
    "elif",
    "switch",
    "case",
    "default",
    "for",
    "while",
    "do",
    "foreach",
    "try",
    "catch",
    "except",
    "finally",
    "and",
    "or",
)
BRANCH_SIGNS = (r"&&", r"\|\|", r"\?")

# The look-ahead lets the matcher skip most characters after one cheap test, the
# plain look-behind most of the others: neither knows the classes of Unicode.
_FIRST = "(?=[" + "".join(sorted({w[0] for w in BRANCH_WORDS})) + "&|?])"
_BRANCH = f"{_FIRST}(?:(?<![a-z0-9_]){WORD_START}(?:{'|'.join(BRANCH_WORDS)}){WORD_END}|{'|'.join(BRANCH_SIGNS)})"
_ELSE_IF = f"(?=e){WORD_START}else{SPACE}+if{WORD_END}"


def _signs(text: Column, sign: str) -> Column:
    """Characters that a sign takes up; most texts lack most signs and are not rewritten."""
    return F.when(text.contains(sign), F.length(text) - F.length(F.replace(text, F.lit(sign)))).otherwise(0)


def cyclomatic_complexity(code: Column) -> Column:
    """Whole part of 1 + branches + half of (arrows + unclosed brackets).

    One alternation counts all whole words and signs in a single scan: they
    cannot overlap each other.
    """
    text = F.lower(code)
    else_if = F.when(text.contains("else"), F.regexp_count(text, F.lit(_ELSE_IF))).otherwise(0)
    arrows = _signs(code, "=>") / 2
    closing = sum((_signs(code, sign) for sign in ")]}"), F.lit(0))
    opening = sum((_signs(code, sign) for sign in "([{"), F.lit(0))
    halves = arrows + F.greatest(F.lit(0), opening - closing)
    return (F.lit(1) + F.regexp_count(text, F.lit(_BRANCH)) + else_if + F.floor(halves / 2)).cast("int")
