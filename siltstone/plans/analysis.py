"""The whole analysis of a tree, as frames and as written tables."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from siltstone.config import ScanConfig
from siltstone.functions.rules import Rule
from siltstone.operators.duplicates import duplicate_issues
from siltstone.operators.extract import extract_functions
from siltstone.operators.graph import CodeGraph, annotate_nodes, build_graph
from siltstone.operators.issues import rule_issues
from siltstone.operators.report import batch_prompts, report_sections
from siltstone.operators.summary import analysis_summary
from siltstone.operators.vectors import code_rows, issue_rows
from siltstone.sources.tables import Collections, read_functions, read_issues, write_functions, write_issues, write_report
from siltstone.sources.tree import scan_archives, scan_file, scan_tree


@dataclass(frozen=True)
class Analysis:
    """Lazy frames of one analysis."""

    functions: DataFrame
    issues: DataFrame
    graph: CodeGraph

    def annotated_nodes(self) -> DataFrame:
        return annotate_nodes(self.graph.nodes, self.issues)

    def summary(self) -> DataFrame:
        return analysis_summary(self.functions, self.issues, self.graph.edge_count())

    def report(self) -> DataFrame:
        return report_sections(self.issues)

    def prompts(self) -> DataFrame:
        return batch_prompts(self.issues, self.functions)


def analyze_functions(
    functions: DataFrame,
    *,
    rules: Sequence[Rule] | None = None,
    by_language: bool = False,
    mode: str = "reference",
) -> Analysis:
    """Analysis of a FUNCTIONS frame.

    The frame is read by several consumers: pass a written table, not one that
    is still to be extracted.
    """
    found = rule_issues(functions, rules, by_language=by_language)
    issues = found.unionByName(duplicate_issues(functions, mode))
    return Analysis(functions, issues, build_graph(functions, by_language=by_language))


def read_files(spark: SparkSession, path: str, config: ScanConfig | None = None) -> DataFrame:
    """FILES of a zip archive, a single file or a tree, by what ``path`` names."""
    name = os.path.basename(path.rstrip("/"))
    if name.lower().endswith(".zip"):
        return scan_archives(spark, path, config)
    if "." in name[1:] and not os.path.isdir(path) and name.rsplit(".", 1)[1].lower() in _EXTENSIONS:
        return scan_file(spark, path)
    return scan_tree(spark, path, config)


_EXTENSIONS = ("py", "js", "jsx", "ts", "tsx", "java")


def analyze(
    spark: SparkSession, path: str, output: str, *, config: ScanConfig | None = None, compat: bool = False, **options
) -> Analysis:
    """Analyse ``path`` and write functions, issues, collections and report
    below ``output``; the result reads the written tables."""
    extracted = extract_functions(read_files(spark, path, config), compat=compat)
    write_functions(extracted, f"{output}/functions", "parquet")
    functions = read_functions(spark, f"{output}/functions", "parquet")
    result = analyze_functions(functions, **options)
    write_issues(result.issues, f"{output}/issues")
    issues = read_issues(spark, f"{output}/issues")
    store = Collections(spark, output)
    store.reset_code(code_rows(functions))
    store.reset_issues(issue_rows(issues))
    write_report(report_sections(issues), f"{output}/report")
    return Analysis(functions, issues, result.graph.written())
