"""Questions answered in batch, and hits widened by their surroundings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.questions import PLANS, route
from siltstone.operators.graph import CodeGraph
from siltstone.operators.vectors import nearest
from siltstone.session import durable


def _per_route(values: dict[str, object], kind: str) -> Column:
    chosen = F.lit(None).cast(kind)
    for name, value in values.items():
        chosen = F.when(F.col("type") == name, F.lit(value)).otherwise(chosen)
    return chosen


def _summary(plans: dict) -> Column:
    chosen = F.lit(None).cast("string")
    for name, (_, _, _, template) in plans.items():
        text = F.lit(template)
        for count in ("issues", "code"):
            text = F.replace(text, F.lit("{%s}" % count), F.col(f"{count}_found").cast("string"))
        chosen = F.when(F.col("type") == name, text).otherwise(chosen)
    return chosen


def answer_questions(
    questions: DataFrame, code: DataFrame, issues: DataFrame, plans: dict | None = None, *, vectors: DataFrame | None = None
) -> DataFrame:
    """Route each question, run the searches of its route and count the hits.

    ``questions`` has ``question_id``, ``question`` and ``vector``; ``code``
    has ``id`` and ``vector``; ``issues`` also ``category``.  Questions with
    the same vector and route are searched once.  With ``vectors`` (``vec_id``,
    ``vector``) all three have ``vec_id`` instead of the vector.
    """
    plans = plans or PLANS
    of = "vector" if vectors is None else "vec_id"
    routed = questions.select("question_id", "question", of, route(F.col("question")).alias("type"))
    asked = routed.groupBy(of, "type").agg(F.min("question_id").alias("query_id"))
    if vectors is not None:
        held = durable(asked.join(vectors.select("vec_id", "vector"), "vec_id"))
        asked = held.groupBy("vector", "type").agg(F.min("query_id").alias("query_id"))
    asked = durable(asked)
    planned = asked.select(
        "query_id",
        "vector",
        _per_route({n: p[0] for n, p in plans.items()}, "string").alias("scope"),
        _per_route({n: p[1] for n, p in plans.items()}, "int").alias("issue_k"),
        _per_route({n: p[2] for n, p in plans.items()}, "int").alias("code_k"),
    )

    def found(corpus: DataFrame, limit: str, kind: str) -> DataFrame:
        wanted = planned.where(F.col(limit) > 0)
        most = max(p[1 if limit == "issue_k" else 2] for p in plans.values())
        hits = nearest(wanted, corpus, most, vectors=vectors).join(wanted.select("query_id", limit), "query_id")
        return hits.where(F.col("rank") <= F.col(limit)).groupBy("query_id").agg(
            F.count("*").alias(f"{kind}_found"), F.min_by("id", "rank").alias(f"best_{kind}")
        )

    in_issues = found(issues.select("id", of, F.col("category").alias("scope")), "issue_k", "issues")
    in_code = found(code.select("id", of), "code_k", "code")
    answers = asked.join(in_issues, "query_id", "left").join(in_code, "query_id", "left").drop("query_id")
    if vectors is not None:
        answers = held.drop("query_id").join(answers, ["vector", "type"]).drop("vector")
    return (
        routed.join(answers, [of, "type"])
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("issues_found", "code_found")})
        .select("question_id", "type", "issues_found", "code_found", "best_issues", "best_code", _summary(plans).alias("summary"))
    )


def code_with_context(hits: DataFrame, collection: DataFrame, graph: CodeGraph) -> DataFrame:
    """Code hits with the neighbours of their file and the other functions in it.

    The lists themselves are ``graph.predecessors`` / ``graph.successors`` and
    the collection rows of the file; here they are counted.
    """
    placed = hits.join(collection.select("id", "file"), "id")
    files = placed.select(F.col("file").alias("id")).distinct()
    known = collection.join(files.select(F.col("id").alias("file")), "file", "left_semi")
    in_file = known.groupBy("file").agg(F.count("*").alias("in_file"))

    def count(neighbours: DataFrame, name: str) -> DataFrame:
        return neighbours.groupBy(F.col("id").alias("file")).agg(F.count("*").alias(name))

    joined = (
        placed.join(in_file, "file", "left")
        .join(count(graph.predecessors(files), "predecessors"), "file", "left")
        .join(count(graph.successors(files), "successors"), "file", "left")
    )
    return joined.select(
        "query_id",
        "rank",
        "id",
        "file",
        F.coalesce("predecessors", F.lit(0)).alias("predecessors"),
        F.coalesce("successors", F.lit(0)).alias("successors"),
        (F.col("in_file") - 1).alias("related_functions"),
    )


def issues_with_context(hits: DataFrame, collection: DataFrame) -> DataFrame:
    """Issue hits with the number of issues of their file, category and severity."""
    joined = hits.join(collection.select("id", "file", "category", "severity"), "id")
    for key in ("file", "category", "severity"):
        counts = collection.groupBy(key).agg(F.count("*").alias(f"{key}_issues"))
        joined = joined.join(counts, key)
    return joined.select(
        "query_id", "rank", "id", "file", "category", "severity", "file_issues", "category_issues", "severity_issues"
    )


def issue_context_rows(hits: DataFrame, collection: DataFrame, key: str) -> DataFrame:
    """The issues that share ``key`` (file, category or severity) with each hit."""
    asked = hits.join(collection.select("id", key), "id").select("query_id", "rank", key)
    return asked.join(collection, key)
