"""Strings and comments of one line of source text, as column functions.

A line begins in a lexical state: 0 in code, or inside something that an
earlier line opened (1 to 4, see ``OPENERS``).  What a line does to the states
is a text of five digits, the state behind the line for each state before it,
so the effect of two lines is ``translate(first, "01234", second)``.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

STATES = "01234"
UNMOVED = "01200"  # what a line without quotes, comment signs and backslashes does
CODE = "0"
TOKEN = r"[\p{L}\p{N}_$#]+|=>|->|\.\.\.|\*\*|\S"
OPENING, CLOSING = ("(", "[", "{"), (")", "]", "}")
NAME = r"\A#?[\p{L}_$][\p{L}\p{N}_$]*\z"
_MARK, _CLOSED = "\x01", "\x02"

# What opens each of the states 1 to 4; the last two hold on for a line that ends in a backslash.
OPENERS = {
    "python": ('"""', "'''", '"', "'"),
    "javascript": ("/*", "`", '"', "'"),
    "java": ("/*", '"""'),
}


def _inside(quote: str) -> str:
    """Anything up to a quote, past escaped signs; possessive, so that long lines need no stack."""
    return rf"(?:\\.|(?!{quote})[^\\])*+"


# Whole strings leave their quote (group 1 or 2); what the line leaves open is kept as it stands (the other groups).
_PYTHON = (
    r"(?s)#.*|(?<!\w)[rRbBfFuUtT]{0,2}+(?:"
    rf"(\"\"\"|\x27\x27\x27){_inside(r'\1')}\1|((\"\"\"|\x27\x27\x27){_inside(r'\3')}\\?)\z"
    rf"|([\"\x27]){_inside(r'\4')}\4|(([\"\x27]){_inside(r'\6')}\\)\z)"
)
_JAVASCRIPT = (
    r"(?s)//.*|/\*.*?\*/|(/\*.*)\z"
    rf"|([\"\x27`]){_inside(r'\2')}\2|(`{_inside('`')}\\?)\z|(([\"\x27]){_inside(r'\5')}\\)\z"
    r"|(?<=[=(,:\[!&|?{};])[ \t]*+/(?![/*])(?:\\.|\[(?:\\.|[^\]\\])*+\]|[^/\\\[])++/"
)
_JAVA = rf"(?s)//.*|/\*.*?\*/|(/\*.*)\z|(\"\"\"){_inside(r'\2')}\2|(\"\"\"{_inside('\"\"\"')}\\?)\z|([\"\x27]){_inside(r'\4')}\4"
_BLANK = {
    "python": (_PYTHON, f" $1$4{_MARK}$2$5"),
    "javascript": (_JAVASCRIPT, f" $2{_MARK}$1$3$4"),
    "java": (_JAVA, f" $2$4{_MARK}$1$3"),
}
_LEFT_OPEN = rf"{_MARK}(/\*|\"\"\"|\x27\x27\x27|[\"\x27`])"


def is_name(tok: Column, reserved: tuple[str, ...] | list[str] = ()) -> Column:
    return F.coalesce(tok.rlike(NAME), F.lit(False)) & ~F.coalesce(tok.isin(*reserved), F.lit(False))


def unmatched(brackets: Column) -> Column:
    """Whether brackets do not match, read with a stack of those that are still to come; what cannot match stays on it."""
    for _ in range(3):  # neighbours that match leave nothing on the stack
        brackets = F.regexp_replace(brackets, r"\(\)|\[\]|\{\}", "")

    def read(stack: Column, sign: Column) -> Column:
        wanted = F.translate(sign, "".join(OPENING), "".join(CLOSING))
        shut = F.substr(stack, F.lit(1), F.length(stack) - 1)
        return F.when(sign == "", stack).when(wanted != sign, F.concat(stack, wanted)).when(stack.endswith(sign), shut).otherwise(F.concat(stack, F.lit("!")))

    return F.aggregate(F.split(brackets, ""), F.lit(""), read) != ""


def then(first: Column, second: Column) -> Column:
    """The effect of one line or run of lines, then of another."""
    return F.call_function("translate", first, F.lit(STATES), second)


def by_language(language: Column, made) -> Column:
    """``made(name)`` for the language of each row; null for others."""
    out = None
    for name in OPENERS:
        out = F.when(language == name, made(name)) if out is None else out.when(language == name, made(name))
    return out


def plain(text: Column) -> Column:
    """The text without the signs that mark places here."""
    return F.translate(text, _MARK + _CLOSED, "  ")


def stays_in_code(content: Column, language: Column) -> Column:
    """Whether a text holds nothing that could leave a string or comment open over lines: all its lines begin in code."""
    signs = {name: [sign for sign in opens if len(sign) > 1 or sign == "`"] for name, opens in OPENERS.items()}
    signs = {name: [*found, "\\"] if len(OPENERS[name]) > 2 else found for name, found in signs.items()}
    return by_language(language, lambda name: ~reduce(or_, (content.contains(sign) for sign in signs[name])))


def moves(text: Column) -> Column:
    """Whether a line can change a state at all; a line behind a backslash does so too."""
    return text.rlike(r"[\"\x27`\\]|/\*|\*/")


def _blanked(text: Column, language: str) -> Column:
    return F.regexp_replace(text, *map(F.lit, _BLANK[language]))


def _state_of(opener: Column, language: str) -> Column:
    states = F.create_map(*(F.lit(x) for k, sign in enumerate(OPENERS[language], 1) for x in (sign, str(k))))
    return F.coalesce(F.try_element_at(states, opener), F.lit(CODE))


def _behind(text: Column, state: int, language: str) -> Column:
    """The text behind what closes a state, after one sign; the whole text where nothing does."""
    sign = OPENERS[language][state - 1]
    if sign == "/*":
        return F.regexp_replace(text, r"(?s)\A.*?\*/", _CLOSED)
    return F.regexp_replace(text, rf"(?s)\A{_inside(sign)}{sign}", _CLOSED)


def _left_open(text: Column, language: str) -> Column:
    """The state behind a text that begins in code."""
    return _state_of(F.regexp_extract(_blanked(text, language), _LEFT_OPEN, 1), language)


def _from(text: Column, state: int, language: str) -> Column:
    """The state behind a line that begins in one of the states 1 to 4."""
    opener = OPENERS[language][state - 1]
    rest = _behind(text, state, language)
    stays = F.lit(str(state)) if state < 3 else F.when(text.endswith("\\"), str(state)).otherwise(CODE)
    closed = rest.startswith(_CLOSED)
    return F.when(~text.contains("*/" if opener == "/*" else opener), stays).when(closed, _left_open(F.substring(rest, 2, 1 << 30), language)).otherwise(stays)


def effect(text: Column, language: Column, behind_backslash: Column) -> Column:
    """What a line does to each state, as five digits.

    Only a line behind a backslash can begin in the states 3 and 4.
    """

    def of(name: str) -> Column:
        digits = [_left_open(text, name)]
        for state in range(1, 5):
            if state > len(OPENERS[name]):
                digits.append(F.lit(CODE))
                continue
            digit = _from(text, state, name)
            digits.append(digit if state < 3 else F.when(behind_backslash, digit).otherwise(CODE))
        return F.concat(*digits)

    return by_language(language, of)


def after(text: Column, state: Column, behind_backslash: Column, language: str) -> Column:
    """The state behind a line, given the one before it: one digit of its effect."""
    out = F.when(~behind_backslash & ~moves(text), F.translate(state, STATES, UNMOVED)).when(state == CODE, _left_open(text, language))
    for k in range(1, 1 + len(OPENERS[language])):
        out = out.when((state == str(k)) & (F.lit(k < 3) | behind_backslash), _from(text, k, language))
    return out.otherwise(CODE)


def code_in(text: Column, state: Column, language: str) -> Column:
    """As ``code_of``, for one language."""
    out = F.when(state == CODE, text)
    for k in range(1, 1 + len(OPENERS[language])):
        rest = _behind(text, k, language)
        out = out.when(state == str(k), F.when(rest.startswith(_CLOSED), F.substring(rest, 2, 1 << 30)).otherwise(""))
    blank = _blanked(out.otherwise(text), language)
    whole = F.translate(F.regexp_replace(blank, rf"(?s){_LEFT_OPEN}.*", " \" "), _MARK + _CLOSED, "")
    return F.when((state == CODE) & ~text.rlike(r"[\"\x27`#/]"), text).otherwise(whole)


def quiet_python(content: Column) -> Column:
    """As ``code_of`` for all lines of a Python text of which ``stays_in_code`` is true."""
    blank = F.regexp_replace(content, r"#[^\n]*|(?=[rRbBfFuUtT\"\x27])(?<!\w)[rRbBfFuUtT]{0,2}+([\"\x27])(?:(?!\1)[^\n])*+\1", f" $1{_MARK}")
    return F.translate(F.regexp_replace(blank, rf"{_LEFT_OPEN}[^\n]*", " \" "), _MARK, "")


def code_of(text: Column, state: Column, language: Column) -> Column:
    """The line with comments gone and every string as one quote, given the state before it."""
    return by_language(language, lambda name: code_in(text, state, name))
