"""Rules that look at one function and may report one issue each.

A rule is a set of column expressions, so Catalyst optimises rules added by a
user exactly as it does the built-in ones.  Columns need a running session,
hence the callables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import SPACE, WORD_START

# Patterns, labels, severities and limits of the rules.
# ``sql_injection`` means quote, plus, quote on one line and ``jdbc_concat``
# plus-quote and quote-parenthesis on the line of the call; both are written
# so that a line is scanned once, however long it is.  A leading look-ahead
# tests the first letter before the costlier word boundary.
EVAL_EXEC = rf"(?=e){WORD_START}(?:eval|exec){SPACE}*\("
SQL_INJECTION = r"""(?md)^[^"'\n]*+["'][^+\n]*+\+[^"'\n]*+["']"""
WEAK_HASH = rf"(?=[ms]){WORD_START}(?:md5|sha1){SPACE}*\("
HARDCODED_SECRET = rf"""(?=[aApPsS\u017ftT])(?iu)(?:api[_-]?key|password|secret|token){SPACE}*={SPACE}*["'][^"']+["']"""
JS_PATTERNS = {
    "eval": rf"(?=e){WORD_START}eval{SPACE}*\(",
    "function_constructor": rf"new{SPACE}+Function{SPACE}*\(",
    "inner_html": rf"\.innerHTML{SPACE}*=",
    "document_write": rf"document\.write{SPACE}*\(",
}
JAVA_PATTERNS = {
    "runtime_exec": rf"Runtime\.getRuntime\(\)\.exec{SPACE}*\(",
    "weak_crypto": rf"""MessageDigest\.getInstance\({SPACE}*"(?:MD5|SHA1)"{SPACE}*\)""",
    "jdbc_concat": rf"""Statement\.execute(?:Query|Update){SPACE}*\((?>[^\n]*?\+")[^\n]*?"\)""",
}
JS_LITERALS = {
    "eval": "eval",
    "function_constructor": "Function",
    "inner_html": ".innerHTML",
    "document_write": "document.write",
}
JAVA_LITERALS = {
    "runtime_exec": "Runtime.getRuntime().exec",
    "weak_crypto": "MessageDigest.getInstance(",
    "jdbc_concat": "Statement.execute",
}
LONG, VERY_LONG = 200, 500
COMPLEX, VERY_COMPLEX = 10, 15
DEEP = 3
BLOCK_COMMENT_LANGUAGES = ("java", "js", "jsx", "ts", "tsx")


@dataclass(frozen=True)
class Rule:
    """One check.  ``label``, ``severity`` and ``explanation`` may depend on
    the row; plain strings stand for constants."""

    rule_id: str
    category: str
    label: str | Callable[[], Column]
    severity: str | Callable[[], Column]
    predicate: Callable[[], Column]
    explanation: str | Callable[[], Column]
    suggestion: str
    languages: tuple[str, ...] = ()


def text_of(value: str | Callable[[], Column]) -> Column:
    return F.lit(value) if isinstance(value, str) else value()


def matches(text: Column, pattern: str, *literals: str) -> Column:
    """Search for a pattern; of ``literals`` every match holds at least one.

    A plain search for them spares most rows the regular expression.
    """
    possible = [text.contains(literal) for literal in literals]
    return reduce(or_, possible) & text.rlike(pattern) if possible else text.rlike(pattern)


def code_matches(pattern: str, *literals: str) -> Callable[[], Column]:
    return lambda: matches(F.col("code"), pattern, *literals)


def holds_secret(text: Column) -> Column:
    return matches(text, HARDCODED_SECRET, "=")


def _counted(template: str, column: str) -> Callable[[], Column]:
    before, after = template.split("{}")
    return lambda: F.concat(F.lit(before), F.col(column).cast("string"), F.lit(after))


def _above(column: str, limit: int) -> Callable[[], Column]:
    return lambda: F.when(F.col(column) > limit, F.lit("High")).otherwise(F.lit("Medium"))


def has_block_comment(code: Column) -> Column:
    """A ``/**`` and, after it, a ``*/``."""
    start = F.instr(code, "/**")
    return (start > 0) & (F.locate("*/", F.substr(code, start + 3)) > 0)


def lacks_documentation() -> Column:
    name, extension = F.col("function"), F.lower(F.substring_index("file", ".", -1))
    public = ~name.startswith("_") | (name.startswith("__") & name.endswith("__"))
    return F.when(extension == "py", public & ~F.col("has_docstring")).when(
        extension.isin(*BLOCK_COMMENT_LANGUAGES), ~has_block_comment(F.col("code"))
    )


def _security_rules() -> list[Rule]:
    python = [
        Rule(
            "R1",
            "security",
            "Use of eval/exec",
            "High",
            code_matches(EVAL_EXEC, "eval", "exec"),
            "Text passed to eval() or exec() runs as code.",
            "Parse the value with a function made for its format, such as ast.literal_eval().",
        ),
        Rule(
            "R2",
            "security",
            "Potential SQL injection",
            "High",
            code_matches(SQL_INJECTION, "+"),
            "A string is joined with + between quotes, as in a query built by hand.",
            "Bind the values as parameters of a prepared statement.",
        ),
        Rule(
            "R3",
            "security",
            "Weak cryptographic hash",
            "Medium",
            code_matches(WEAK_HASH, "md5", "sha1"),
            "Collisions can be made for MD5 and SHA-1.",
            "Hash with SHA-256 or a later algorithm.",
        ),
        Rule(
            "R4",
            "security",
            "Hardcoded secret detected",
            "High",
            lambda: holds_secret(F.col("code")),
            "A credential stands in the source text.",
            "Read it from the environment or a secret store.",
        ),
    ]
    javascript = [
        Rule(
            f"R{5 + i}",
            "security",
            f"JS Security: {name}",
            "High",
            code_matches(pattern, JS_LITERALS[name]),
            f"The code uses {name} in an unsafe way.",
            "Use an API that does not run or render raw text.",
            ("javascript",),
        )
        for i, (name, pattern) in enumerate(JS_PATTERNS.items())
    ]
    java = [
        Rule(
            f"R{9 + i}",
            "security",
            f"Java Security: {name}",
            "High",
            code_matches(pattern, JAVA_LITERALS[name]),
            f"The code uses {name} in an unsafe way.",
            "Use a safer class of the platform or a maintained library.",
            ("java",),
        )
        for i, (name, pattern) in enumerate(JAVA_PATTERNS.items())
    ]
    return python + javascript + java


def default_rules() -> tuple[Rule, ...]:
    """The built-in rules in the order in which their issues are listed."""
    return (
        *_security_rules(),
        Rule(
            "R12",
            "complexity",
            _counted("Function too long ({} lines)", "function_length"),
            _above("function_length", VERY_LONG),
            lambda: F.col("function_length") > LONG,
            _counted("The function spans {} lines.", "function_length"),
            "Move parts of it into functions of their own.",
        ),
        Rule(
            "R13",
            "complexity",
            _counted("High cyclomatic complexity ({})", "complexity"),
            _above("complexity", VERY_COMPLEX),
            lambda: F.col("complexity") > COMPLEX,
            _counted("The function has a branch score of {}.", "complexity"),
            "Split the branches over smaller functions.",
        ),
        Rule(
            "R14",
            "complexity",
            _counted("Excessive nesting depth ({})", "nesting_depth"),
            "Medium",
            lambda: F.col("nesting_depth") > DEEP,
            _counted("Statements are nested {} levels deep.", "nesting_depth"),
            "Return early or move inner blocks out.",
        ),
        Rule(
            "R15",
            "documentation",
            "Missing documentation",
            "Low",
            lacks_documentation,
            lambda: F.concat(F.lit("Nothing documents the function "), F.col("function"), F.lit(".")),
            "Add a docstring or a documentation comment.",
        ),
    )
