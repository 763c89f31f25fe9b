"""Functions with the same normalised code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.normalize import code_hash
from siltstone.operators.skew import lookup_join
from siltstone.session import durable

RULE_ID = "D1"
RULE_POS = 16
SUGGESTION = "Move the common code into one shared function or class."


def fingerprints(functions: DataFrame, mode: str = "reference") -> DataFrame:
    """One narrow row per function; the code itself goes no further."""
    return functions.select(
        "func_id",
        "file",
        "class_name",
        "function",
        "start_line",
        "end_line",
        code_hash(F.col("code"), mode).alias("code_hash"),
    )


def duplicate_groups(prints: DataFrame) -> DataFrame:
    """Hashes that more than one function has, with size and first member."""
    groups = prints.groupBy("code_hash").agg(
        F.count("*").alias("members"), F.min("func_id").alias("lead_id")
    )
    return groups.where("members > 1")


def duplicate_members(prints: DataFrame) -> DataFrame:
    """Every function of a duplicate group with the size of its group.

    ``prints`` is used twice; pass a written or checkpointed frame.
    """
    return lookup_join(prints, duplicate_groups(prints), "code_hash", "members", prints.count())


def duplicate_group_files(prints: DataFrame) -> DataFrame:
    """The files of each duplicate group and how many of its functions each holds."""
    held = prints.groupBy("code_hash", "file").agg(F.count("*").alias("functions"))
    return held.join(duplicate_groups(prints).select("code_hash"), "code_hash", "left_semi")


def _explanation() -> Column:
    return F.concat(
        F.lit("The same code is in "),
        (F.col("members") - F.col("_own")).cast("string"),
        F.lit(" functions of other files; duplicate group "),
        F.col("code_hash"),
        F.lit(" has "),
        F.col("members").cast("string"),
        F.lit(" members."),
    )


def duplicate_issues(functions: DataFrame, mode: str = "reference", *, texts: bool = True) -> DataFrame:
    """One issue per member of each duplicate group.

    The explanation names the group, its size and how many members are in
    other files, in one form for groups of any size; ``duplicate_group_files``
    lists the files.
    """
    prints = durable(fingerprints(functions, mode))
    members = duplicate_members(prints)
    columns = [
        F.lit(1).alias("phase"),
        "lead_id",
        "func_id",
        "file",
        "class_name",
        "function",
        F.array("start_line", "end_line").alias("lines"),
        F.lit(RULE_POS).alias("rule_pos"),
        F.lit(RULE_ID).alias("rule_id"),
        F.lit("duplication").alias("category"),
        F.lit("Duplicate function detected").alias("issue"),
        F.lit("Medium").alias("severity"),
    ]
    if not texts:
        return members.select(*columns)
    own = prints.groupBy("code_hash", "file").agg(F.count("*").alias("_own"))
    counted = lookup_join(members, own.where("_own > 1"), ["code_hash", "file"], "_own", prints.count(), how="left")
    counted = counted.withColumn("_own", F.coalesce("_own", F.lit(1)))
    return counted.select(*columns, _explanation().alias("explanation"), F.lit(SUGGESTION).alias("suggestion"))


def all_issues(functions: DataFrame, *, mode: str = "reference", texts: bool = True, **options) -> DataFrame:
    """Rule issues followed by duplicate issues."""
    from siltstone.operators.issues import rule_issues

    rules = rule_issues(functions, texts=texts, **options)
    return rules.unionByName(duplicate_issues(functions, mode, texts=texts))


def duplicate_documents(documents: DataFrame) -> DataFrame:
    """Documents with equal text, as hash and number of copies."""
    groups = documents.groupBy(F.md5("text").alias("text_hash")).agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")
    )
    return groups.where("copies > 1")
