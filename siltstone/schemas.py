"""Schemas of the frames that operators hand to each other."""

from pyspark.sql import types as T

FILES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)

FUNCTIONS = T.StructType(
    [
        T.StructField("func_id", T.LongType()),
        T.StructField("file", T.StringType()),
        T.StructField("class_name", T.StringType()),
        T.StructField("function", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("parameters", T.ArrayType(T.StringType())),
        T.StructField("function_length", T.IntegerType()),
        T.StructField("nesting_depth", T.IntegerType()),
        T.StructField("has_docstring", T.BooleanType()),
        T.StructField("calls", T.ArrayType(T.StringType())),
        T.StructField("imports", T.ArrayType(T.StringType())),
        T.StructField("parent_file", T.StringType()),
        T.StructField("code", T.StringType()),
    ]
)

# ``phase`` (0 rules, 1 duplicates), ``lead_id``, ``func_id`` and ``rule_pos``
# together give the order in which issues are listed.
ISSUES = T.StructType(
    [
        T.StructField("phase", T.IntegerType()),
        T.StructField("lead_id", T.LongType()),
        T.StructField("func_id", T.LongType()),
        T.StructField("rule_pos", T.IntegerType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("class_name", T.StringType()),
        T.StructField("function", T.StringType()),
        T.StructField("lines", T.ArrayType(T.IntegerType())),
        T.StructField("category", T.StringType()),
        T.StructField("issue", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("explanation", T.StringType()),
        T.StructField("suggestion", T.StringType()),
    ]
)

ISSUE_ORDER = ("phase", "lead_id", "func_id", "rule_pos")

NODES = T.StructType([T.StructField("id", T.StringType()), T.StructField("type", T.StringType())])

EDGES = T.StructType(
    [
        T.StructField("src", T.StringType()),
        T.StructField("dst", T.StringType()),
        T.StructField("type", T.StringType()),
    ]
)
