"""Column functions over paths and source text.

Whitespace and word characters follow Python's ``str`` methods, which know
more of them than Java's plain ``\\s`` and ``\\w``; the classes are spelled out
so that the result depends on no regex flag.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.config import LANGUAGES

SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
NO_SPACE = r"[^\s\x1c-\x1f\x85\p{Z}]"
LINE_SPACE = r"[\t\x0B\f\r\x1c-\x1f\x85\p{Z}]"  # SPACE without the line feed
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())  # the members of SPACE
WORD_START = r"(?<![\p{L}\p{N}_])"
WORD_END = r"(?![\p{L}\p{N}_])"


def strip(text: Column) -> Column:
    """Drop whitespace at both ends."""
    return F.trim(text, F.lit(_SPACES))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_suffix(path: Column) -> Column:
    """Last suffix with its dot, lower case; a leading dot starts no suffix."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)\z", 1))


def language_of(path: Column) -> Column:
    """Language by suffix, null when the suffix is unknown."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(known, file_suffix(path))


def under_directory(path: Column, names: Iterable[str]) -> Column:
    """Whether a directory above the file has one of ``names``."""
    parts = F.split(path, "/")
    above = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.arrays_overlap(above, F.array(*[F.lit(n) for n in names]).cast("array<string>"))


def glob_regex(glob: str) -> str:
    """Shell glob as a regular expression; ``*`` and ``?`` also match ``/``."""
    out, rest = "", glob
    while rest:
        head, rest = rest[0], rest[1:]
        close = rest.find("]", 2 if rest[:1] == "!" else 1) if head == "[" else -1
        if head == "*":
            out += ".*"
        elif head == "?":
            out += "."
        elif close > 0:
            inner, rest = rest[:close], rest[close + 1 :]
            negate = inner.startswith("!")
            members = "".join(c if c.isalnum() or c == "-" else "\\" + c for c in inner[negate:])
            out += f"[{'^' if negate else ''}{members}]"
        else:
            out += head if head.isalnum() or head == "_" else "\\" + head
    return out


def matches_glob(path: Column, globs: Iterable[str]) -> Column:
    """Whether the base name or the whole path matches one of the globs."""
    regex = "(?s)^(?:" + "|".join(glob_regex(g) for g in globs) + r")\z"
    return base_name(path).rlike(regex) | path.rlike(regex)


def universal_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def slice_lines(lines: Column, start: Column, length: Column) -> Column:
    """Text of ``length`` lines from the 1-based line ``start`` on."""
    return F.array_join(F.slice(lines, start, length), "\n")


def has_docstring(code: Column) -> Column:
    """At least two lines and a triple quote within the first five."""
    lines = F.split(strip(code), "\n", 6)
    quoted = F.exists(F.slice(lines, 1, 5), lambda s: s.contains('"""') | s.contains("'''"))
    return (F.size(lines) > 1) & quoted


def imports_before(lines: Column, start: Column) -> Column:
    """Import lines from the top through the function's first line."""
    stripped = F.transform(F.slice(lines, F.lit(1), start), strip)
    return F.filter(stripped, lambda s: s.startswith("import ") | s.startswith("from "))


def node_id(file: Column, class_name: Column, function: Column) -> Column:
    """``file::class::function``, or ``file::function`` without a class."""
    return F.concat_ws("::", file, F.when(class_name != "", class_name), function)


def import_target(statement: Column, by_language: Column | None = None) -> Column:
    """Module file an import statement points to, null when it names none.

    ``from a.b`` gives ``a/b.py`` and ``import a.b`` gives ``a.py`` whatever
    the language.  With ``by_language`` (a language column) Java imports give
    ``a/b.java`` and JavaScript imports and ``require`` calls give ``x.js``.
    """
    text = strip(statement)
    second = F.regexp_extract(text, f"{SPACE}+({NO_SPACE}+)", 1)
    python = F.when(
        text.startswith("from "), F.concat(F.replace(second, F.lit("."), F.lit("/")), F.lit(".py"))
    ).when(text.startswith("import "), F.concat(F.substring_index(second, ".", 1), F.lit(".py")))
    if by_language is None:
        return python
    java = F.when(
        text.startswith("import "),
        F.concat(F.replace(F.regexp_replace(second, ";", ""), F.lit("."), F.lit("/")), F.lit(".java")),
    )
    quoted = F.coalesce(
        F.nullif(F.regexp_extract(text, r"""\sfrom\s+["']([^"']+)["']""", 1), F.lit("")),
        F.nullif(F.regexp_extract(text, r"""^import\s+["']([^"']+)["']""", 1), F.lit("")),
        F.nullif(F.regexp_extract(text, r"""require\(\s*["']([^"']+)["']""", 1), F.lit("")),
    )
    return (
        F.when(by_language == "java", java)
        .when(by_language == "javascript", F.concat(quoted, F.lit(".js")))
        .otherwise(python)
    )
