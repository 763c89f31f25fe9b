"""Applying rules to functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.complexity import cyclomatic_complexity
from siltstone.functions.rules import Rule, default_rules, text_of
from siltstone.functions.text import language_of


def with_complexity(functions: DataFrame) -> DataFrame:
    if "complexity" in functions.columns:
        return functions
    return functions.withColumn("complexity", cyclomatic_complexity(F.col("code")))


def _applies(rule: Rule, by_language: bool) -> Column:
    if by_language and rule.languages:
        return rule.predicate() & language_of(F.col("file")).isin(*rule.languages)
    return rule.predicate()


def _finding(rule: Rule, position: int, texts: bool) -> Column:
    fields = [
        F.lit(position).alias("rule_pos"),
        F.lit(rule.rule_id).alias("rule_id"),
        F.lit(rule.category).alias("category"),
        text_of(rule.label).alias("issue"),
        text_of(rule.severity).alias("severity"),
    ]
    if texts:
        fields += [
            text_of(rule.explanation).alias("explanation"),
            F.lit(rule.suggestion).alias("suggestion"),
        ]
    return F.struct(*fields)


def _location() -> list[Column]:
    return [
        F.lit(0).alias("phase"),
        F.col("func_id").alias("lead_id"),
        F.col("func_id"),
        F.col("file"),
        F.col("class_name"),
        F.col("function"),
        F.array("start_line", "end_line").alias("lines"),
    ]


def rule_issues(
    functions: DataFrame,
    rules: Sequence[Rule] | None = None,
    *,
    by_language: bool = False,
    texts: bool = True,
) -> DataFrame:
    """All findings of all rules, in one pass over the functions.

    ``texts=False`` leaves explanation and suggestion out, for callers that
    only count.  Works on batch and streaming frames alike.
    """
    rules = tuple(rules or default_rules())
    checks = F.array(
        *[
            F.when(_applies(rule, by_language), _finding(rule, i, texts))
            for i, rule in enumerate(rules, 1)
        ]
    )
    found = F.filter(checks, lambda finding: finding.isNotNull())
    return with_complexity(functions).select(*_location(), F.inline(found))


def issues_of_rule(functions: DataFrame, rule_id: str, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Findings of one rule; the other rules are not evaluated."""
    rules = tuple(rules or default_rules())
    position, rule = next((i, r) for i, r in enumerate(rules, 1) if r.rule_id == rule_id)
    source = with_complexity(functions)
    return source.where(rule.predicate()).select(*_location(), _finding(rule, position, True).alias("f")).select(
        "*", "f.*"
    ).drop("f")
