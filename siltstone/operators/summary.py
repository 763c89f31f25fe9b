"""Counts over functions, issues and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import base_name


def issues_by(issues: DataFrame, *columns: str) -> DataFrame:
    return issues.groupBy(*columns).agg(F.count("*").alias("issues"))


def counts_map(counts: DataFrame, key: str, value: str = "issues") -> DataFrame:
    """One row with a map; the keys are a closed set of categories or severities."""
    return counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value)))).alias(f"by_{key}"))


def _side_by_side(*frames: DataFrame) -> DataFrame:
    """One-row frames as one row, without a join."""
    rows = frames[0]
    for frame in frames[1:]:
        rows = rows.unionByName(frame, allowMissingColumns=True)
    return rows.agg(*[F.any_value(c, True).alias(c) for c in rows.columns])


def analysis_summary(functions: DataFrame, issues: DataFrame, edge_count: DataFrame) -> DataFrame:
    """One row: totals, the two maps, and the number of files that have functions."""
    by_kind = issues_by(issues, "category", "severity")
    per_category = by_kind.groupBy("category").agg(F.sum("issues").alias("issues"))
    per_severity = by_kind.groupBy("severity").agg(F.sum("issues").alias("issues"))
    per_file = functions.groupBy("file").agg(F.count("*").alias("n"))
    return _side_by_side(
        per_file.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total_functions"), F.count("*").alias("files_analyzed")
        ),
        by_kind.agg(F.coalesce(F.sum("issues"), F.lit(0)).alias("total_issues")),
        counts_map(per_category, "category").withColumnRenamed("by_category", "issues_by_category"),
        counts_map(per_severity, "severity").withColumnRenamed("by_severity", "issues_by_severity"),
        edge_count.select(F.col("edges").alias("dependencies")),
    )


def graph_summary(node_count: DataFrame, edge_count: DataFrame, annotated: DataFrame) -> DataFrame:
    """One row: nodes, edges and the issues counted on nodes."""
    issues = annotated.agg(F.coalesce(F.sum("total_issues"), F.lit(0)).alias("issues"))
    return _side_by_side(node_count.select("nodes"), edge_count.select("edges"), issues)


def rollup_maps(annotated: DataFrame) -> DataFrame:
    """Issue counts of all nodes by category and by severity."""
    parts = [
        annotated.select(F.lit(kind).alias("kind"), F.explode(column).alias("name", "n"))
        for kind, column in (("category", "issues_by_category"), ("severity", "severity_distribution"))
    ]
    return parts[0].unionByName(parts[1]).groupBy("kind", "name").agg(F.sum("n").alias("issues"))


def top_issue_files(annotated: DataFrame, n: int = 10) -> DataFrame:
    """The n nodes with most issues, ties by id; nodes without any are left out."""
    return (
        annotated.where("total_issues > 0")
        .orderBy(F.desc("total_issues"), "id")
        .limit(n)
        .select("id", base_name(F.col("id")).alias("name"), "total_issues")
    )


def report_header(issues: DataFrame) -> DataFrame:
    """Counts of the issues a report covers."""
    severity = F.lower("severity")
    return issues.agg(
        F.count("*").alias("total"),
        F.count_if(severity == "high").alias("high"),
        F.count_if(severity == "medium").alias("medium"),
    )


def collection_stats(code: DataFrame, issues: DataFrame) -> DataFrame:
    counted = [
        frame.agg(F.lit(name).alias("collection"), F.count("*").alias("rows"))
        for name, frame in (("code_functions", code), ("issues", issues))
    ]
    return counted[0].unionByName(counted[1])


def enriched_report(issues: DataFrame, functions: DataFrame) -> DataFrame:
    """Issues with the measures of their function."""
    measures = functions.select(
        "func_id", "parameters", "function_length", "nesting_depth", "has_docstring", "code"
    )
    return issues.join(measures, "func_id")
