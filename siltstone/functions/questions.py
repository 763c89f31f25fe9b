"""Routing of questions by the words they hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of each route, tried from top to bottom.
ROUTES = {
    "security": ("security", "vulnerability", "injection", "crypto", "secret"),
    "performance": ("performance", "bottleneck", "slow", "optimize"),
    "duplication": ("duplicate", "copy", "similar"),
    "documentation": ("documentation", "docstring", "comment"),
    "complexity": ("complex", "complexity", "nested"),
}
OTHERWISE = "general"
DEBUG_WORD = "think"

# Per route the issue category searched (None for all), the
# number of issues and the number of functions, and the words of the summary.
PLANS = {
    "security": ("security", 10, 5, "Found {issues} security issues and {code} related code functions."),
    "performance": ("complexity", 10, 5, "Found {issues} complexity issues and {code} related code functions."),
    "duplication": ("duplication", 10, 0, "Found {issues} duplicate functions."),
    "documentation": ("documentation", 10, 0, "Found {issues} documentation issues."),
    "complexity": ("complexity", 10, 0, "Found {issues} complexity issues."),
    "general": (None, 5, 5, "Found {code} relevant code functions and {issues} related issues."),
}


def route(question: Column) -> Column:
    """First route one of whose words occurs anywhere in the question."""
    text = F.lower(question)
    chosen = F.lit(OTHERWISE)
    for name in reversed(ROUTES):
        chosen = F.when(text.rlike("|".join(ROUTES[name])), name).otherwise(chosen)
    return chosen


def wants_debugging(text: Column) -> Column:
    return F.lower(text).contains(DEBUG_WORD)
