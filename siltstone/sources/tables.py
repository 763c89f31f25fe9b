"""Writing and reading of functions, issues, collections and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.operators.report import report_issues
from siltstone.schemas import FUNCTIONS, ISSUES


def write_functions(functions: DataFrame, path: str, fmt: str = "json") -> None:
    functions.write.mode("overwrite").format(fmt).save(path)


def read_functions(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(FUNCTIONS).format(fmt).load(path)


def write_issues(issues: DataFrame, path: str) -> None:
    issues.write.mode("overwrite").json(path)


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    """All saved issues."""
    return spark.read.schema(ISSUES).json(path)


def load_report_issues(spark: SparkSession, path: str) -> DataFrame:
    """Saved issues of high or medium severity."""
    return report_issues(read_issues(spark, path))


class Collections:
    """Code and issue collections as Parquet below one folder.

    Issues are partitioned by category, so that a category filter reads its
    own files only.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.code_path, self.issue_path = f"{folder}/code_functions", f"{folder}/code_issues"

    def reset_code(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(self.code_path)

    def reset_issues(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").partitionBy("category").parquet(self.issue_path)

    def add_code(self, rows: DataFrame) -> None:
        if not rows.isEmpty():
            rows.write.mode("append").parquet(self.code_path)

    def add_issues(self, rows: DataFrame) -> None:
        if not rows.isEmpty():
            rows.write.mode("append").partitionBy("category").parquet(self.issue_path)

    def code(self) -> DataFrame:
        return self.spark.read.parquet(self.code_path)

    def issues(self) -> DataFrame:
        return self.spark.read.parquet(self.issue_path)


def write_report(sections: DataFrame, path: str) -> None:
    """Report text in section order; part files follow each other by name."""
    ordered = sections.repartitionByRange("number").sortWithinPartitions("number")
    ordered.select("text").write.mode("overwrite").text(path)
