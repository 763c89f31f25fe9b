"""Report rows: filtered, numbered, explained and batched issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import slice_lines
from siltstone.operators.ordering import with_position
from siltstone.operators.summary import report_header
from siltstone.schemas import ISSUE_ORDER

BATCH = 4

TITLE = "# Code Quality Report"
EMPTY = f"{TITLE}\n\nNo issue of high or medium severity was found.\n"
NO_EXPLANATION = "No explanation provided"
NO_SUGGESTION = "No suggestion provided"

# Per category: heading of the explanation, closing sentence, and whether a
# high severity keeps a high priority.
SECTIONS = {
    "security": ("Security", "An attacker could make use of it.", True),
    "complexity": ("Complexity", "Such code is hard to read, test and change.", True),
    "documentation": ("Documentation", "Readers have to work out what the code is for.", False),
    "duplication": ("Duplication", "Each change has to be made in every copy.", False),
}

PROMPT_HEAD = (
    "Check each issue below, which a static analysis has flagged. Leave out those that are no real issue. "
    "For each of the others say why it matters and how to fix it, most severe first, in Markdown, "
    "in at most 200 words.\n"
)


def report_issues(issues: DataFrame) -> DataFrame:
    """Issues of high or medium severity, in any case; a missing one drops out."""
    return issues.where(F.lower("severity").isin("high", "medium"))


def numbered(issues: DataFrame) -> DataFrame:
    """Report order: high first, then by severity, then as listed; from 1 on."""
    severity = F.lower("severity")
    keyed = issues.withColumns({"_not_high": severity != "high", "_severity": severity})
    return with_position(keyed, "_not_high", "_severity", *ISSUE_ORDER, name="number", first=1).drop(
        "_not_high", "_severity"
    )


def with_priority(issues: DataFrame) -> DataFrame:
    """Add why, how and priority as the issue's category has them."""
    severity = F.lower("severity")
    category = F.lower("category")
    reason = F.coalesce("explanation", F.lit(NO_EXPLANATION))
    why, priority = reason, F.initcap(severity)
    for name, (heading, closing, keeps_high) in SECTIONS.items():
        text = F.concat(F.lit(f"**{heading}:** "), reason, F.lit(f"\n\n{closing}"))
        level = F.when(severity == "high", "High").otherwise("Medium") if keeps_high else F.lit("Medium")
        why = F.when(category == name, text).otherwise(why)
        priority = F.when(category == name, level).otherwise(priority)
    return issues.withColumns(
        {"why": why, "how": F.coalesce("suggestion", F.lit(NO_SUGGESTION)), "priority": priority}
    )


def _place() -> Column:
    return F.concat(
        "file", F.lit(" (lines "), F.get("lines", F.lit(0)).cast("string"), F.lit("-"), F.get("lines", F.lit(1)).cast("string"), F.lit(")")
    )


def report_sections(issues: DataFrame) -> DataFrame:
    """(number, text): the header as number 0, then one section per issue."""
    kept = report_issues(issues)
    shown = ("file", "lines", "severity", "category", "issue", "explanation", "suggestion")
    rows = with_priority(numbered(kept.select(*ISSUE_ORDER, *shown)))
    section = F.concat(
        F.lit("### Issue "),
        F.col("number").cast("string"),
        F.lit(": "),
        "issue",
        F.lit("\n**File:** "),
        _place(),
        F.lit("\n**Severity:** "),
        "severity",
        F.lit("\n**Category:** "),
        "category",
        F.lit("\n\n**Why it matters:**\n"),
        "why",
        F.lit("\n\n**How to fix it:**\n"),
        "how",
        F.lit("\n\n**Priority:** "),
        "priority",
        F.lit("\n\n---\n"),
    )
    counted = F.concat(
        F.lit(f"{TITLE}\n\n**Issues:** "),
        F.col("total").cast("string"),
        F.lit("\n**High:** "),
        F.col("high").cast("string"),
        F.lit("\n**Medium:** "),
        F.col("medium").cast("string"),
        F.lit("\n\n---\n"),
    )
    header = report_header(kept).select(
        F.lit(0).cast("bigint").alias("number"), F.when(F.col("total") > 0, counted).otherwise(F.lit(EMPTY)).alias("text")
    )
    return header.unionByName(rows.select("number", section.alias("text")))


def with_batch(rows: DataFrame, size: int = BATCH) -> DataFrame:
    """Number of the batch (from 1) of a numbered issue."""
    return rows.withColumn("batch", F.floor((F.col("number") - 1) / size) + 1)


def batch_counts(rows: DataFrame) -> DataFrame:
    """Number of issues in each batch."""
    return rows.groupBy("batch").agg(F.count("*").alias("issues"))


def batch_prompts(issues: DataFrame, functions: DataFrame, size: int = BATCH) -> DataFrame:
    """(batch, prompt): one text for each batch of issues, with their code.

    An issue covers the lines of its function, so the code comes from there.
    """
    shown = ("file", "lines", "severity", "category", "issue")
    rows = with_batch(numbered(report_issues(issues).select(*ISSUE_ORDER, *shown)), size)
    coded = rows.join(functions.select("func_id", "code"), "func_id", "left")
    within = ((F.col("number") - 1) % size + 1).cast("string")
    block = F.concat(
        F.lit("\n### Issue "),
        within,
        F.lit("\nFile: "),
        _place(),
        F.lit("\nSeverity: "),
        "severity",
        F.lit("\nCategory: "),
        "category",
        F.lit("\nIssue: "),
        "issue",
        F.lit("\nCode:\n"),
        F.coalesce("code", F.lit("")),
        F.lit("\n"),
    )
    # At most ``size`` issues per group.
    blocks = F.sort_array(F.collect_list(F.struct("number", block.alias("text"))))
    return coded.groupBy("batch").agg(blocks.alias("b")).select(
        "batch",
        F.concat(F.lit(PROMPT_HEAD), F.array_join(F.transform("b", lambda x: x["text"]), "")).alias("prompt"),
    )


def extract_lines(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Lines start..end, both included, of each requested file.

    ``requests`` has ``path``, ``start_line``, ``end_line``; ``files`` has
    ``path`` and ``content``.
    """
    start = F.greatest("start_line", F.lit(1))
    length = F.greatest(F.col("end_line") - start + 1, F.lit(0))
    lines = F.split("content", "\n", -1)
    return requests.join(files.select("path", "content"), "path").select(
        *requests.columns, slice_lines(lines, start, length).alias("text")
    )
